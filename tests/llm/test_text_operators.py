"""Row-wise operators: byte BPE, extraction, media, pseudonyms, fingerprints, against plain versions and round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import byte_bpe, extraction, fingerprint, media, pseudonyms

ODD = [None, "", " ", "a", "  two  spaces ", "l'été à　x\x1cy\x85z", "x" * 300, "it's WE'LL 123 4567\n\n\tend \n", "🙂🙂 ퟿", "word " * 4000, "a b", "a b", "<|endoftext|> y"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, words string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None, None, None, 1, "clash") for k, t in enumerate(ODD)] + [(None, "no id", None, None, None, 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_byte_bpe_equals_the_library(spark, odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.encode_documents(odd, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    assert len(found) == len(ODD) + 1
    for r in found:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert r.n_tokens == len(library.encode_ordinary(text)) and r.decoded == text.encode()
    assert byte_bpe.encode_documents(odd.limit(0), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0


def test_long_words(spark):
    """A word of 100,000 letters in seconds; the fold and the heap agree at their boundary."""
    import random
    import time

    import tiktoken

    draw = random.Random(0)
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (100_000, *range(byte_bpe.LONGEST - 2, byte_bpe.LONGEST + 3))] + ["a" * 70, "é" * 33]
    start = time.time()
    assert byte_bpe.merge_long(texts[0].encode(), ranks) == library.encode_ordinary(texts[0]) and time.time() - start < 5
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    for r in byte_bpe.encode_documents(frame, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id]) and r.decoded.decode() == texts[r.doc_id]


def test_rank_table():
    """Every merge is found and nothing else."""
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    moved, entries = byte_bpe.rank_table(ranks)
    pairs = {}
    for piece, made in ranks.items():
        if len(piece) > 1:
            left, right = byte_bpe.last_merge(piece, ranks)
            pairs[ranks[left], ranks[right]] = made
    assert len(pairs) == len(ranks) - 256
    for left, right in [*pairs, *((int(a), int(b)) for a, b in np.random.default_rng(0).integers(0, len(ranks), (20_000, 2)))]:
        found = entries[moved[left] + right] ^ (left << 16)
        assert found == pairs[left, right] if (left, right) in pairs else found >= byte_bpe.IDS


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes on<p>Short.</p><aside>Side</aside><form><input>Mail</form>
<div class="comments"><p>Reader</p></div><script>var t="</p>";</script><p>&lt;end&gt; &#233;</p></article><footer>&copy;</footer>"""


def test_extraction():
    assert extraction.main_text(PAGE) == "A & B\n\nFirst line goes on\n\nShort.\n\n<end> é"
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<p></p>") == ""
    plain = "<body><nav>menu</nav><div><p>" + "Long text here. " * 20 + "</p><p>Short.</p></div><div class='sidebar'>x</div><p><a href='#'>only a link</a></p></body>"
    assert extraction.main_text(plain) == ("Long text here. " * 20).strip() + "\n\nShort."


def test_a_removed_element_ends_no_block():
    long, short = "Long text. " * 90, "A short last paragraph."
    assert extraction.main_text(f'<body><div><p>{long}</p><div class="ad">x</div><p>{short}</p></div></body>') == f"{long.strip()}\n\n{short}"
    assert extraction.main_text(f'<body><div><p>{long}</p><p><a href="#">Its source</a></p></div><div><a href="#">More</a></div></body>') == f"{long.strip()}\n\nIts source"


def test_skipped_elements_end_where_html_ends_them():
    assert extraction.main_text('<article><p class="notice">Note<p>A</p><p>B</p></article>') == "A\n\nB"
    assert extraction.main_text('<article><ul><li class="share">S</ul><p>A<ul><li class="share">S<li>B</ul></article><p>out') == "A\n\nB"
    assert extraction.main_text("<article><table><tr class=promo><td>q<tr><td class=ad>x<td>B</table><div class=ad>y</article><article>C</article>") == "B\n\nC"
    assert extraction.main_text('<div class="content has-sidebar"><!-- <main> --><div class="sidebar">s</div><article><p>A</p></article></div>') == "A"
    assert extraction.main_text('<aside><article>Teaser</article></aside><article>A<div class="comments"><article>Reader</article></div></article>') == "A"


def test_formulas_and_drawings_stay():
    assert extraction.main_text("<article><p>Let <math><mi>x</mi></math> be <svg><title>t</title><text>y</text></svg> or <object>z</object></article>") == "Let x be y or z"
    assert extraction.main_text("<article><p>One long paragraph.<p class='share'>Share this<p>Two paragraph.<p>Three</article>") == "One long paragraph.\n\nTwo paragraph.\n\nThree"
    assert extraction.main_text("<article><ul><li>A<li class='related'>R<li>B</ul><p>C</article>") == "A\n\nB\n\nC"


def test_surge_and_dive():
    """Against sums formed anew for each window."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        weights = (rng.integers(0, 3, int(rng.integers(0, 30))) * rng.integers(0, 2)).tolist()
        kept = set()
        sums = [sum(weights[i : i + extraction.WINDOW]) for i in range(len(weights))]
        kept = {i for i, x in enumerate(sums) if x > 0}
        found = extraction.regions(weights)
        assert {i for a, b in found for i in range(a, b)} == kept and all(b < c for (_, b), (c, _) in zip(found, found[1:], strict=False))


def test_windows_decide_on_lines_that_weigh_nothing():
    """Fewer than WINDOW links within a text stay, more are a menu; the lines that weigh alone would not tell."""

    def found(*within):
        return [extraction.main_text(f"<body><div><p>The text before.</p>{x}<p>The text behind.</p></div></body>").split("\n\n")[1:-1] for x in within]

    rows = "<table><tr><td><a>Paris</a></td><td>two million</td></tr><tr><td><a>Lyon</a><td>half a million</table>"
    assert found(rows, "<figure><a><figcaption>A harbour</figcaption></a></figure>", "<blockquote><a>Said</a> <a>so</a></blockquote>") == [["Paris", "two million", "Lyon", "half a million"], ["A harbour"], ["Said so"]]
    assert found("<div><a>A</a> <a>B</a> <a>C</a></div>", "<div><ul><li><a>A</a><li><a>B</a><li><a>C</a></ul></div>", "<div><div class='ad'>x</div></div>") == [[], [], []]
    page = "<body><div><a>Home</a></div><h1>Title</h1><div><a>Menu</a></div><div><p>Text</p></div><div><a>More</a></div><div>End</div><div><a>Top</a></div></body>"
    assert extraction.main_text(page) == "Title\n\nText\n\nEnd"
    assert extraction.main_text("<article>A</article><p>out</p><article>B</article>") == "A\n\nB"


def test_windows_against_runs():
    """Against runs of weightless lines, on random pages without articles; no line that weighs is lost."""
    draw, bridged = random.Random(0), 0
    for _ in range(1000):
        page, pieces = "", ["<div>", "</div>", "<table><tr><td>", "<td>", "</table>", "<figure>", "</figure>", *["<p>some text</p>"] * 3, *["<p><a>link</a> <a>link</a></p>", "<p><a>link</a></p>"] * 2]
        for n in range(draw.randint(1, 25)):
            page += draw.choice(pieces).replace("link", f"link{n}").replace("some", f"some{n}")
        lines = extraction.lines_of(page)
        weights = extraction.weights_of(lines)
        weighty = [i for i, w in enumerate(weights) if w]
        kept = set(weighty)
        for a, b in zip(weighty, weighty[1:], strict=False):
            if all(x.joined for x in lines[a + 1 : b + 1]) and sum(max(1, x.links) for x in lines[a + 1 : b]) < extraction.WINDOW:
                kept |= set(range(a, b))
        bridged += len(kept) > len(weighty)
        assert extraction.main_text(page) == "\n\n".join(lines[i].text for i in sorted(kept))
    assert bridged > 50


class Blocks(__import__("html.parser").parser.HTMLParser):
    """A plain second reader: a stack of elements, p and li closed by the next block; text of articles outside boilerplate."""

    BLOCK = set("html body nav ul li div article h1 h2 p footer header aside section".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.end()
            while self.stack and self.stack[-1][0] not in self.BLOCK - {"p"} and any(t == "p" for t, _ in self.stack):
                self.stack.pop()
        if tag == "br":
            self.text.append(" ")
        elif tag not in ("meta", "br", "img", "link", "hr", "input"):
            skipped = tag in ("nav", "footer", "script", "style", "title", "head", "form", "aside") or dict(attrs).get("class") in ("ad", "sidebar", "notice", "comments")
            self.stack.append((tag, skipped))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.end()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(s for _, s in self.stack):
            self.text.append(data)


def test_extraction_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in extraction.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    assert [r.page_id for r in rows if found[r.page_id] != "\n\n".join(Blocks(r.html).blocks)] == []


def test_extraction_frame(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (2, None, None, 8)], "page_id long, url string, html string, n_chars int")
    rows = extraction.extract_pages(frame).collect()
    assert sorted((r.page_id, r.n_chars, r.text) for r in rows) == [(1, len(extraction.main_text(PAGE)), extraction.main_text(PAGE))] * 2 + [(2, 0, "")]
    assert extraction.extract_pages(frame.limit(0)).count() == 0


def test_media_round_trip(odd):
    from strandflow.llm.common import materialize

    stored = materialize(media.attach_payloads(odd), "media")
    found = media.resolve(media.parse_sequences(stored), media.media_features(stored)).join(stored.select("row", "doc_id", "n_bytes"), "row").collect()
    assert len(found) == len(ODD) + 1
    for r in found:
        own = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        data = own.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        lines = own.split("\n")
        before, after = ([t for x in part if (t := " ".join(x.split()))] for part in (lines[: len(lines) // 2], lines[len(lines) // 2 :]))
        assert [x.item.text for x in r.sequence] == [*before, None, *after, None] and [x.item.position for x in r.sequence] == list(range(len(r.sequence)))
        item, again = (x for x in r.sequence if x.item.kind == "media")
        assert (item.item.caption, again.item.caption) == (f"{len(data)} bytes of document {r.doc_id}", f"document {r.doc_id} again") and item.media == again.media
        assert (item.media.payload_bytes, item.media.payload_sha256, item.media.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        png = media.store_png(payload)
        assert (item.media.media_bytes, item.media.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert media.read_png(png).tobytes() == payload
    assert media.attach_payloads(odd.limit(0)).count() == 0


def test_sequences_stay_aligned(spark):
    page = "<p>one<img src='media:aa' alt='x'>two</p><figure><img src='media:bb'><img src='media:none'><figcaption>both &amp;</figcaption></figure><script>no</script>"
    items = media.parse_sequence(page)
    assert [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [("text", "one", None), ("media", "aa", "x"), ("text", "two", None), ("media", "bb", "both &"), ("media", "none", "both &")]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "row long, html string")
    payloads = spark.createDataFrame([("aa", 1), ("bb", 2)], "digest string, size int")
    found = {r.row: r.sequence for r in media.resolve(media.parse_sequences(pages), payloads).collect()}
    assert [x.media and x.media.size for x in found[1]] == [None, 1, None, 2, None] and found[2] is None and found[3] is None
    references = spark.createDataFrame([(1, [(1, "aa"), (3, "bb"), (4, "none")])], "row long, references array<struct<position:int,digest:string>>")
    assert [(x.position, x.media and x.media.size) for x in media.resolve_references(references, payloads).first().resolved] == [(1, 1), (3, 2), (4, None)]
    with pytest.raises(ValueError):
        media.read_png(media.store_png(b"\0" * 576)[:-20] + b"\0" * 20)


def test_no_reference_or_caption_is_lost():
    def plain(page):
        return [(i["kind"], i["text"] or i["reference"], i["digest"], i["caption"]) for i in media.parse_sequence(page)]

    assert plain("<figure><img src='http://x/y.png'><figcaption>cap</figcaption></figure><p>t</p>") == [("media", "http://x/y.png", None, "cap"), ("text", "t", None, None)]
    assert plain("<figure><figcaption>alone</figcaption></figure>t") == [("text", "alone", None, None), ("text", "t", None, None)]
    assert plain("<figure><img src=media:a><figcaption>never <p>closed") == [("media", "media:a", "a", "never closed")]


def test_sequences_of_real_pages(spark):
    """Each page's items hold all of its text outside scripts and styles, in order."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("row", F.col("page_id"))
    found = {r.row: r["items"] for r in media.parse_sequences(rows).collect()}
    for r in rows.collect():
        import html
        import re

        whole = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", r.html, flags=re.S)
        whole = html.unescape(re.sub(r"<[^>]*>", "", whole))
        assert "".join("".join(i.text for i in found[r.page_id]).split()) == "".join(whole.split()) and [i.position for i in found[r.page_id]] == list(range(len(found[r.page_id])))


VALUES = 'und.34@mail7.example.com 4785380592391139 152.143.123.131 +1 (743) 555-3824 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 2021-03-04 123-45-6789'


def test_pseudonyms():
    change = pseudonyms.Pseudonymizer("k")
    new, spans = change(VALUES)
    assert [k for k, _, _ in spans] == ["email", "card", "ipv4", "phone", "secret", "date", "ssn"]
    assert not set(VALUES.replace('"', "").split()[:3]) & set(new.replace('"', "").split())
    assert change(VALUES)[0] == new and pseudonyms.Pseudonymizer("other")(VALUES)[0] != new
    card = new.split()[1]
    assert len(card) == 16 and pseudonyms.check_digit(card[:-1]) == card[-1]
    for clean in ("9807915762804490", "300.1.1.1", "2021-13-40", "12 cats, 3.14 and 1999", "Is it 7?", ""):
        assert change(clean) == (clean, [])


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutations(size):
    made = [pseudonyms.moved(v, size, b"k", "t") for v in range(size)]
    assert sorted(made) == list(range(size)) and (size == 1 or all(a != b for a, b in enumerate(made)))
    assert all(pseudonyms.unfeistel(pseudonyms.feistel(v, size, b"k", "t"), size, b"k", "t") == v for v in range(size))


def test_pseudonym_frame(spark, odd):
    rows = pseudonyms.pseudonymize(odd, "k").collect()
    assert len(rows) == len(ODD) + 1 and rows[0].text is None and rows[0].words == "clash"
    assert all(r.text == ODD[r.doc_id] for r in rows if r.doc_id not in (None, 7))


def test_fingerprints(spark, odd):
    texts = [(3, "c" * 50), (9, "abcdef"), (5, None), (7, "line one, line two"), (7, "a"), (7, "a")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("task", F.lit(1))
    rows = fingerprint.fingerprint_pairs(frame).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    assert by[9].n_chars == 6 and by[3].edited_sha256 == hashlib.sha256(("c" * 25 + "abcdef").encode()).hexdigest()
    assert by[5].fingerprint == by[5].edited_fingerprint and by[5].near_edited == 1.0
    assert all(0 <= r.near_next <= 1 and r.fingerprint == fingerprint.digest({9: "abcdef", 3: "c" * 50, 5: ""}.get(r.doc_id, "").encode()) for r in rows if r.doc_id != 7)
    assert fingerprint.likeness(by[9].fingerprint, by[9].fingerprint) == 1 and fingerprint.fingerprint_pairs(frame.limit(0)).count() == 0
    one = fingerprint.fingerprint_pairs(frame.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_against_plain_counts():
    """Counts, quartile codes, differences and likeness by loops, from the definitions."""
    import random

    draw = random.Random(2)
    texts = [bytes(draw.choices(b"abcde fghij\xc3\xa9", k=n)) for n in (0, 1, 3, 4, 5, 50, 400, 3000)]

    def codes(data):
        counts = [0] * 256
        for at in range(len(data) - 3):
            w = data[at : at + 4]
            for salt, (i, j, k) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3)), 1):
                h = (w[i] * 0x9E3779B1 + w[j]) % 2**32
                h = (h * 0x85EBCA77 + w[k] * 0x01000193 + salt) % 2**32
                counts[(h * 0xC2B2AE3D) % 2**32 >> 24] += 1
        q = sorted(counts)
        return [sum(c > q[at] for at in (63, 127, 191)) for c in counts], (q[63], q[127], q[191])

    made = [fingerprint.digest(t) for t in texts]
    for text, mark in zip(texts, made, strict=True):
        own, (a, b, top) = codes(text)
        body = bytes.fromhex(mark[4:])
        assert [body[k // 4] >> (6 - 2 * (k % 4)) & 3 for k in range(256)] == own
        assert int(mark[2], 16) == min(15, a * 15 // max(1, top)) and int(mark[3], 16) == min(15, b * 15 // max(1, top))
    for x, m in zip(texts, made, strict=True):
        for y, n in zip(texts, made, strict=True):
            gaps = [abs(a - b) for a, b in zip(codes(x)[0], codes(y)[0], strict=True)]
            least = sum(6 if g == 3 else g for g in gaps) + 12 * min(16, abs(int(m[:2], 16) - int(n[:2], 16))) + abs(int(m[2], 16) - int(n[2], 16)) + abs(int(m[3], 16) - int(n[3], 16))
            assert fingerprint.difference(m, n) == least and 0 <= fingerprint.likeness(m, n) <= 1


def test_near_columns(spark):
    """Every column of every row of documents by the contract, in plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in fingerprint.fingerprint_pairs(docs).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    for (key, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        other = (text[: len(text) - half] + after[:half]).encode()
        own, r = fingerprint.digest(text.encode()), rows[key]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(other).hexdigest(), own, fingerprint.digest(other))
        assert r.near_edited == fingerprint.likeness(own, fingerprint.digest(other)) and r.near_next == fingerprint.likeness(own, fingerprint.digest(after.encode()))


def test_byte_bpe_blocks_hold_every_match():
    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    match = byte_bpe.word_pattern(tokenizers.PATTERN).findall
    rng = random.Random(2)
    signs = [*"ab1,.!?;:'sé×÷жα你\0-", "don't", "word", "\U0001f600", "́"]
    texts = [None, "", "\n", " "]
    for between in ([*" \n\t\xa0\x85\x1c", "  ", "\n\n", " \n"], ["", "", " ", " ", "\n"]):  # any white space, single white space
        texts += ["".join(rng.choice(signs) + rng.choice(between) * rng.randint(0, 1) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    words, seen = [], 0
    for block in byte_bpe._blocks(tokenizers.PATTERN, ranks, "doc_id", "text")(iter([batch])):
        words += block.column("words")[0].as_py()
        for row in block.column("docs")[0].as_py():
            got = [words[i] for i in np.frombuffer(row["words"], np.uint32)]
            assert got == [[ranks[bytes([b])] for b in w.encode()] for w in match(texts[row["id"]] or "")], repr(texts[row["id"]])
            seen += 1
    assert seen == len(texts) and len({tuple(w) for w in words}) == len(words)
