"""Operators 5, 8 and 10: media columns, HTML extraction and WARC archives."""

import hashlib
import html as h
import itertools
import random
import re
import zlib

import pytest

from geolith.llm import html_extract, media, queries, warc

TEXTS = [None, "", "a", "x" * 63, "y" * 64, "é" * 40, "z" * 16_384, "z" * 16_385, "long " * 60_000, "nul\x00end"]


@pytest.mark.parametrize("size", [64, 128, 162, 163, 164, 184, 345, 346, 347, 348, 530, 16_384, 16_448, 200_000])
def test_stream_round_trip(size):
    payload = random.Random(size).randbytes(size)
    stream = media.write_stream(payload)
    got = media.read_stream(stream)
    assert got["payload"] == payload and not got["errors"] and len(stream) % 188 == 0
    assert got["timestamps"] == [3600 * k for k in range(-(-size // media.UNIT))]
    assert len(got["random_access"]) == -(-len(got["timestamps"]) // media.RANDOM_ACCESS)
    assert all(stream[x] == 0x47 for x in got["random_access"])


def test_crc_and_stamps():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7
    for t in (0, 1, 90_000, (1 << 33) - 1):
        s = media._stamp(t)
        assert (s[0] >> 1 & 7) << 30 | s[1] << 22 | (s[2] >> 1) << 15 | s[3] << 7 | s[4] >> 1 == t


def test_damaged_streams():
    payload = bytes(range(256)) * 200
    s = media.write_stream(payload)
    lost = media.read_stream(s[: 188 * 10] + s[188 * 11 :])
    assert any("counter" in e for e in lost["errors"]) and lost["payload"] == payload[16_384:]
    table = bytearray(s)
    table[10] ^= 1
    assert media.read_stream(bytes(table))["errors"]
    assert "cut" in media.read_stream(s[:-5])["errors"]
    sync = bytearray(s)
    sync[188 * 5] = 0
    assert any("sync" in e for e in media.read_stream(bytes(sync))["errors"])
    for cut in (1, 50, 187, 188 * 3 + 7):  # found again after lost bytes; the units that were not touched are whole
        got = media.read_stream(s[: 188 * 120] + s[188 * 120 + cut :])
        assert any("sync" in e or "counter" in e for e in got["errors"]) and got["payload"] == payload[:16_384] + payload[32_768:], cut
    assert media.read_stream(b"noise" + s)["payload"] == payload and media.read_stream(b"\x47" * 100 + s)["payload"] == payload
    assert media.read_stream(b"")["payload"] == b"" and media.read_stream(b"junk" * 100)["payload"] == b""


def packet(pid, counter, data, start=False, field=b""):
    """A packet with all of data, filled up by its adaptation field."""
    room = 184 - len(data)
    if room or field:
        fill = (field or b"\x00") + b"\xff" * (room - 1 - len(field or b"\x00")) if room > 1 else b""
        return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x30 | counter & 15, room - 1]) + fill + data
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x10 | counter & 15]) + data


def pes(data, stream=0xE0, stamp=None, size=None):
    head = b"\x80" + (b"\x80\x05" + media._stamp(stamp) if stamp is not None else b"\x00\x00")
    return b"\x00\x00\x01" + bytes([stream]) + (len(head + data) if size is None else size).to_bytes(2, "big") + head + data


def split_section(pid, section, counter=0, pointer=b"\x00"):
    data = pointer + section
    parts = [data[i : i + 184] for i in range(0, len(data), 184)]
    return b"".join(packet(pid, counter + k, x.ljust(184, b"\xff"), k == 0) for k, x in enumerate(parts))


def test_streams_of_other_writers():
    many = [(n, 0x200 + n) for n in range(1, 61)]  # 60 programs: a table of two packets
    pat = media._section(0, 1, b"\x00\x00\xe0\x10" + b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in many))
    described = b"\x05\x04TEST" * 40  # descriptors that carry a map over two packets
    body = (0xE500).to_bytes(2, "big") + (0xF000 | len(described)).to_bytes(2, "big") + described + b"\x1b" + (0xE500).to_bytes(2, "big") + b"\xf0\x00" + b"\x0f" + (0xE501).to_bytes(2, "big") + b"\xf0\x03abc"
    pmt = media._section(2, 7, body)
    tables = split_section(0, pat) + b"".join(split_section(0x200 + n, media._section(2, n, b"\xe5\x99\xf0\x00\x06\xe6\x00\xf0\x00")) for n, _ in many if n != 7) + split_section(0x207, pmt)
    video = [b"first unit " * 30, b"second " * 40, b"third"]
    packets, c = [], 0
    for k, x in enumerate(video):
        whole = pes(x, stamp=9000 * k if k < 2 else None, size=0)  # of no stated length
        for i in range(0, len(whole), 170):
            packets.append(packet(0x500, c, whole[i : i + 170], i == 0, b"\x40" if i == 0 and k == 0 else b""))
            c += 1
    packets.insert(2, packets[1])  # sent twice
    audio = packet(0x501, 5, pes(b"sound", 0xC0, 1), True) + packet(0x501, 9, pes(b"after a marked break", 0xC0, 2), True, b"\x80") + packet(0x501, 10, b"\x00\x00\x01\xbf\x00\x04bare", True)
    stream = tables + b"".join(packets) + packet(0x1FFF, 0, b"null") + audio
    got = media.read_stream(stream, program=7)
    assert got["errors"] == [] and got["payload"] == b"".join(video) and got["timestamps"] == [0, 9000, None] and len(got["random_access"]) == 1
    assert len(got["programs"]) == 60 and got["programs"][7] == [(0x1B, 0x500), (0x0F, 0x501)] and got["programs"][3] == [(6, 0x600)]
    got = media.read_stream(stream, pid=0x501)
    assert got["payload"] == b"soundafter a marked breakbare" and got["timestamps"] == [1, 2, None] and not got["errors"]
    assert media.read_stream(stream, program=99)["payload"] == b"" and media.read_stream(stream)["payload"] == b""  # program 1's stream has no packet
    both = media._section(0, 1, b"\x00\x01\xe1\x00\x00\x02\xe1\x00")  # two programs' maps in one PID, and two sections in one packet
    one, two = (media._section(2, n, b"\xe5\x00\xf0\x00\x06" + (0xE500 + n).to_bytes(2, "big") + b"\xf0\x00") for n in (1, 2))
    got = media.read_stream(split_section(0, both) + split_section(0x100, one) + split_section(0x100, two, 1) + packet(0x502, 0, pes(b"of two"), True), program=2)
    assert got["payload"] == b"of two" and got["programs"] == {1: [(6, 0x501)], 2: [(6, 0x502)]} and not got["errors"]


def test_a_part_is_read_by_time():
    payload = random.Random(2).randbytes(1_000_000)
    stream, stamps, offsets, times = media.write_indexed(payload)
    assert stamps == media.read_stream(stream)["timestamps"] and len(offsets) == len(times) == -(-len(stamps) // media.RANDOM_ACCESS)
    for first, last in ((0, 0), (3600 * 17, 3600 * 17), (3600 * 8, 3600 * 30), (3600 * 60, 10**9), (0, 10**9)):
        got = media.read_from(stream, offsets, times, first, last)
        a, b = first // 3600 // 8 * 8, min(len(stamps), last // 3600 // 8 * 8 + 8)
        assert not got["errors"] and got["timestamps"] == stamps[a:b] and got["payload"] == payload[a * media.UNIT : b * media.UNIT]


def test_media_column(spark, sf_dir):
    df = spark.createDataFrame([(i, t, b"clash", 7) for i, t in enumerate(TEXTS)] + [(None, "a", None, None), (2, "a", None, None)], "doc_id long, text string, media binary, n_bytes long")
    got = media.media_column(df).collect()
    assert len(got) == len(TEXTS) + 2 and media.media_column(df.limit(0)).count() == 0
    same = {}
    for r in got:
        t = "a" if r.doc_id is None else TEXTS[r.doc_id]
        data = media.pad(t)
        assert len(data) % 64 == 0 and len(data) >= 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        s = media.write_stream(data)
        assert (r.media_bytes, r.media_sha256) == (len(s), hashlib.sha256(s).hexdigest())
        assert same.setdefault(t, r[1:]) == r[1:] and "index=same" in r.feature and r.feature.endswith("points=" + " ".join(f"{a}@{b}" for a, b in zip(*media.write_indexed(data)[2:])))
    back = media.from_media(media.to_media(df)).collect()
    assert all(bytes(r.payload) == media.pad("a" if r.doc_id is None else TEXTS[r.doc_id]) and not r.errors for r in back)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op5_media(spark, sf_dir).collect():
        assert r.payload_sha256 == hashlib.sha256(media.pad(docs[r.doc_id])).hexdigest() and "errors=0" in r.feature


def cut_cost(s, t, edges, keep):
    return sum(t[i] if k else s[i] for i, k in enumerate(keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 8)
        s, t = ([rng.choice([0, 1, 2, 3.5]) for _ in range(n)] for _ in range(2))
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.5, 1, 4])) for _ in range(rng.randrange(0, 12))]
        every = [(cut_cost(s, t, edges, k), -sum(k)) for k in itertools.product([False, True], repeat=n)]
        got = html_extract.minimum_cut(s, t, edges)
        least = min(x for x, _ in every)
        assert abs(cut_cost(s, t, edges, got) - least) < 1e-9
        assert sum(got) == max(-m for x, m in every if x < least + 1e-9)  # of equal cuts the one with the most content


def test_reduction_alone_settles_pages_as_flow_does(sf_dir, monkeypatch):
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet'").fetchall()]
    for page in [PAGE, *map(plain_page, pages)]:
        own = html_extract.blocks(page)
        terminals = [html_extract.costs(x) for x in html_extract.odds(own)]
        s, t, edges = [x[0] for x in terminals], [x[1] for x in terminals], html_extract.edges(own)
        near = [{} for _ in own]
        for a, b, w in edges:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + w
        flow = html_extract._by_flow(list(range(len(own))), [a - b for a, b in zip(s, t)], near)
        monkeypatch.setattr(html_extract, "_by_flow", None)
        assert html_extract.minimum_cut(s, t, edges) == flow
        monkeypatch.undo()
        if len(own) <= 14:
            best = min(cut_cost(s, t, edges, k) for k in itertools.product([False, True], repeat=len(own)))
            assert abs(cut_cost(s, t, edges, flow) - best) < 1e-9


def plain_page(page, names=True):
    """A page without the markup that names its parts."""
    page = re.sub(r"<(/?)(?:article|nav|footer|header|aside|main|form|section)(?=[\s>])", r"<\1div", page)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", page) if names else page


def inside(page):
    """Blocks of an article of the test tables."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = [" ".join(h.unescape(re.sub("<[^>]*$|<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return [x for x in parts if x]


def f_score(pages, keep):
    right = wrong = missed = 0
    for page, want in pages:
        got = {b.text for b, odds, kept in html_extract.labelled(page) if keep(odds, kept)}
        right, wrong, missed = right + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    return 2 * right / (2 * right + wrong + missed)


def test_pages_that_do_not_name_their_parts():
    """The classifier sees no tags or names, and the cut, not the classifier alone, gets these pages right."""
    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    assert html_extract.fit(pages[:2000]) == html_extract.WEIGHTS
    rest = pages[2000:]
    assert f_score([(x, inside(x)) for x in rest], lambda _, k: k) == 1
    bare = [(plain_page(x), inside(x)) for x in rest]
    assert f_score(bare, lambda _, k: k) >= 0.999 > 0.99 > f_score(bare, lambda odds, _: odds >= 0)
    divs = [(re.sub(r"<(/?)p(?=[\s>])", r"<\1div", x), want) for x, want in bare]
    assert f_score(divs, lambda _, k: k) > 0.9 > f_score(divs, lambda odds, _: odds >= 0)


def test_time_is_linear():
    import time

    n = 100_000
    odd = {
        "nested": "<div>x " * n, "weak": "".join(f"<div>word{i} one two three four five.</div>" for i in range(n)), "unopened": "<div>" * n + "</section>" * n, "inline": "<b><div>" + "<i>" * n + "</b>" * n,
        "quotes": "<a \"" * n + ">", "marks": "</ " * n, "cut": "<p " * n, "mixed": "<ul>" + "<li>a<div>b</div>" * n, "siblings": "<div>" + "<p>one</p><div><p>two words</p></div>" * (n // 2),
    }
    for name, page in odd.items():
        begun = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - begun < 20, name


def test_markup_that_is_text_or_layout():
    words = "This is a long sentence of the article, with enough words to tell what it is about, and more."
    article = f"<article><h2>Head</h2><p>{words}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p><noscript><p>{words} Again.</p></noscript><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three more</a></ul><header><p>By a writer</p></header></article>"
    want = f"Head\n{words}\nLet x=1 be.\n{words} Again.\nOne\nTwo\nThree more\nBy a writer"
    for body in ("", " class='has-sidebar no-comments'", " class=sidebar", " id='page-with-ads'"):
        assert html_extract.main_text(f"<html{body}><body{body}><div class='content-sidebar-wrap'>{article}</div></body></html>") == want
    assert html_extract.main_text(f"<main><article class=comment><p>{words}</p></article></main>") == ""
    assert html_extract.main_text(f"<div hidden><p>{words}</p></div><p style='display:none'>{words}</p>") == ""
    assert html_extract.main_text("<article><p>a</>b</p></article>") == "ab"


PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{x}</style><script>var t="</p><p>no</p>";</script></head><body class="post">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice"><p>This site uses cookies. Please accept all of them, as we ask nicely.</p></div>
<article><h1>Head &lt;line&gt;</h1><p><b>Bold start.<br><p>First   para&shy;graph&nbsp;with <a href="x>y">a link</a> &eacute; &#233; &#xe9;.
<div class="ad">Buy this wonderful thing now, it is cheap and good and everything.</div><!-- <p>comment</p> -->
<p>Short.</p><ul><li>Item one<li>Item two</ul><form><p>Enter your name here please, it is needed.</p></form>
<p>1 < 2 and 3 > 2</p><section id="comments"><p>I liked this article very much, thank you for it.</p></section></article>
<aside><p>Sidebar text that is long enough to look like a paragraph of the article, really.</p></aside>
<footer>&copy; Someone</footer></body></html>"""
MAIN = "Head <line>\nBold start.\nFirst para­graph with a link é é é.\nShort.\nItem one\nItem two\n1 < 2 and 3 > 2"


def test_main_text():
    assert html_extract.main_text(PAGE) == MAIN
    for cut in range(0, len(PAGE), 7):
        html_extract.main_text(PAGE[:cut])
    for junk in ("", "<", "</", "<p", "<!--", "<script>", "&am", "<p>" * 5000, "</div>" * 50, "<div class='a", "<![CDATA[x]]>"):
        html_extract.main_text(junk)
    no_article = "<body><nav><a href=x>Home</a></nav><div>" + "".join(f"<p>This is sentence number {i} of a plain page without any article element at all.</p>" for i in range(5)) + "<p>Yes.</p></div><footer>Foot</footer></body>"
    assert html_extract.main_text(no_article).count("\n") == 5 and "Home" not in html_extract.main_text(no_article)


def test_extract(spark, sf_dir):
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (None, None, None, "c"), (2, "", "", "c"), (1, "u", PAGE, "c")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", MAIN, len(MAIN))] * 2 + [(None, None, "", 0), (2, "", "", 0)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op8_html_extract(spark, sf_dir).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(h.unescape(re.sub("<[^>]*$|<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_warc(spark):
    long = "é" * 60
    pages = [(5, "http://a/\r\nX: y", long, "c"), (3, "http://b", long, "c"), (9, None, long, "c"), (1, "u", "short", "c"), (2, "u", "short", "c"), (4, "u", None, "c"), (6, "u", "", "c"), (7, "v", "z" * 100, "c"), (8, "v", "q" * 99, "c"), (10, "v", "q" * 99, "c"), (None, "n", "only " * 30, "c"), (7, "v", "z" * 100, "c"), (11, "v", "z" * 100, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    got = {}
    for r in warc.archive(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(pages)
    for p, _, t, _ in pages:
        data = (t or "").encode()
        for r in got[p]:
            assert (r.payload_bytes, r.payload_digest, r.verified) == (len(data), hashlib.sha256(data).hexdigest(), True)
    kind = lambda p: (got[p][0].record_type, got[p][0].refers_to)
    assert kind(3) == ("response", None) and kind(5) == ("revisit", 3) and kind(9) == ("revisit", 3) and kind(11) == ("revisit", 7)
    assert all(kind(p) == ("response", None) for p in (1, 2, 4, 6, 7, 8, 10, None)) and got[7][1].record_type == "response"
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_records_and_store(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    twice = pages.unionByName(pages.selectExpr("page_id + 100000 AS page_id", "url", "html"))
    warc.write_archive(twice, str(tmp_path))
    texts = {r.page_id: r.html.encode() for r in twice.collect()}
    store = warc.read_payloads(spark, str(tmp_path)).collect()
    assert len({bytes(r.payload) for r in store}) == len(store) == len(set(texts.values())) and all(r.verified for r in store)
    for r in warc.read_records(spark, str(tmp_path)).collect():
        raw = bytes(r.record)
        head, _, block = raw.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and block[length:] == b"\r\n\r\n"
        body = block[:length].partition(b"\r\n\r\n")[2]
        assert body == (texts[r.page_id] if r.record_type == "response" else b"")
    spark.createDataFrame([("00", b"other")], "digest string, payload binary").write.mode("append").parquet(f"{tmp_path}/payloads")
    assert [r.verified for r in warc.read_payloads(spark, str(tmp_path)).where("digest = '00'").collect()] == [False]
