"""Operators 1, 2, 3: token files, decontamination and token counts, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from geolith.llm import bpe, decontaminate, queries, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "naïve café\tdon't  we'll\n\n x", "½²ªº 12٣ 漢字 тест", "a<|endoftext|>b", "\x1c\x1d x\x85y\xa0z", "“q” — …", "x" * 70_000, "ab " * 40_000, "a", "a"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, tokens string, shard string, row string"


def odd(spark):
    rows = [(i, t, "en", "s", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None, None, None, None, None), (3, "a", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_classes_are_the_librarys_for_all_but_odd_characters():
    """Every character of Unicode, in places that tell letters, digits, white space and others apart."""
    enc = bpe.encoder(PATH)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    plain = [c for c in every if not enc.strange(c) and not bpe.WHOLE.search(c)]
    assert len(plain) > 250_000
    pieces = lambda x: [x[a:b] for _, (a, b) in enc.library.pre_tokenizer.pre_tokenize_str(x)]
    for i in range(0, len(plain), 128):
        text = " ".join(f"a{c}1 {c}{c} b{c} !{c}?{c}\n{c}  {c}'s{c}" for c in plain[i : i + 128])
        assert bpe.PRETOKEN.findall(text) == pieces(text), hex(ord(plain[i]))
    for c in plain[::97]:
        text = f"a{c}1 {c}{c} b{c} !{c}?{c}\n{c}  {c}'s{c}"
        assert enc.encode(text) == bpe.packed(enc.by_library(text)) and enc.count(text) * 4 == len(enc.encode(text)), hex(ord(c))


MIXED = ["漢字仮名交じり文 と 2² ½ 日本", "Это просто текст, №5 и ещё.", "Ελληνικά κείμενα  με ½ κενά", "£5 © 2024 «mots» à 10 €", "a\u0378b c\U0001F600d", "ⅷ Ⅷ x² y₂ z", "नमस्ते दुनिया १२३", "مرحبا ١٢٣ بكم", "a\u2028b \u3000c\u00a0 d", "²  ² ²²  \n² "]


@pytest.mark.parametrize("text", MIXED)
def test_other_scripts_take_the_words_path(text):
    enc = bpe.encoder(PATH)
    assert enc.plain(text)
    for x in (text, f" {text} ", text * 3, "  ".join([text] * 2)):
        assert enc.encode(x) == bpe.packed(enc.by_library(x)) and enc.count(x) == len(enc.by_library(x))


@pytest.mark.parametrize("seed", range(5))
def test_random_texts(seed):
    import random

    rng, enc = random.Random(seed), bpe.encoder(PATH)
    signs = list("ab  \n\t'.1½²é漢Ж_\u3000\x85") + ["don't", "\x1c", "\u0378", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rng.choice(signs[: rng.choice([10, 18, 22])]) for _ in range(rng.randrange(30)))
        assert enc.encode(text) == bpe.packed(enc.by_library(text)) and enc.count(text) == len(enc.by_library(text)), repr(text)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", " ", "a ", " a", "漢 ½ ½"]
    want = [enc.by_library(x or "") for x in texts]
    ids, n = enc.encode_all(pa.array(texts), np.array([2], "<u4").tobytes())
    assert np.frombuffer(ids, "<u4", int(n.sum())).tolist() == [x for w in want for x in [*w, 2]] and n.tolist() == [len(w) + 1 for w in want]
    assert enc.count_all(pa.array(texts)).tolist() == [len(w) for w in want]
    assert enc.count_all(pa.array(texts[:0], pa.string())).tolist() == [] and enc.encode_all(pa.array(texts).slice(5, 7))[1].tolist() == [len(w) for w in want[5:12]]


@pytest.mark.parametrize("text", ["a  b", "a\n b", "a\n\n b  ", " \n a", "a \n\tb ", "  x", " ", "it's 'll don't've  we're", "a   b \n  c", "x\t y", "a ", "1st 2,000.50 _x_ __"])
def test_words_between_spaces(text):
    enc = bpe.encoder(PATH)
    want = enc.library.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == bpe.packed(want) and enc.count(text) == len(want)


def test_token_counts(spark, sf_dir):
    t = Tokenizer.from_file(PATH)
    df, rows = odd(spark)
    got = sorted(map(tuple, token_counts.count_tokens(df, PATH).collect()), key=str)
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == sorted(((r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n)), key=str)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == len(t.encode(docs[r.doc_id], add_special_tokens=False).ids)
    hist = token_counts.length_histogram(token_counts.count_tokens(df, PATH)).collect()
    assert sum(r.n_docs for r in hist) == len(rows)


def expected_tokens(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, queries.op1_token_files(spark, sf_dir).collect())) == expected_tokens([(r.doc_id, r.text) for r in docs.collect()])
    df, rows = odd(spark)
    got = sorted(map(tuple, token_files.token_output(df, PATH).collect()), key=lambda r: r[1])
    want = expected_tokens([r[:2] for r in rows])  # equal ids stay in the order of the input
    assert got == want
    assert token_files.token_output(df.limit(0), PATH).count() == 0


def test_token_files_layout(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH, row_group_mb=1, page_kb=16)
    seen = -1
    for f in sorted((tmp_path / "t").glob("part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in cols["tokens.list.element"].encodings
            assert cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > seen)
        seen = ids[-1] if ids else seen
    some = token_files.read_tokens(spark, str(tmp_path / "t"), 5, 9)
    assert sorted(r.doc_id for r in some.collect()) == [5, 6, 7, 8, 9]
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan


def brute_contamination(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    own |= {str(x) for x in wins[tuple(w[i : i + k])] if x is not None}
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_mb", [32, 0])
def test_contamination(spark, max_mb):
    docs = [(1, "One two THREE four five six seven eight nine ten eleven."), (2, "x One, two-three four five six seven eight nine ten zebra short item"), (3, None), (4, ""), (None, "short ITEM!"), (5, "É é one " * 3000 + "short item"), (2, "shortitem short items"), (2, "shortitem short items")]
    items = [(10, "one two three four five six seven eight nine ten eleven"), (9, "Short item"), (11, "short item"), (12, None), (13, "!!"), (None, "é")]
    d = spark.createDataFrame([(*x, "c", 5) for x in docs], "doc_id long, text string, words string, n_words long")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(d, b, max_mb=max_mb).collect()), key=str) == brute_contamination(docs, items)
    assert decontaminate.clean(d, b, max_mb=max_mb).count() == sum(not x[-1] for x in brute_contamination(docs, items))
    assert {r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    got = {(r.doc_id, docs[1][1][r.first : r.last]) for r in decontaminate.spans(d, b, max_mb=max_mb).collect() if r.doc_id == 2}
    assert got == {(2, "One, two-three four five six seven eight nine ten"), (2, "short item")}


def test_contamination_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_contamination(docs, items)
    assert sorted(map(tuple, queries.op2_decontaminate(spark, sf_dir).collect()), key=str) == want
    assert any(x[-1] for x in want)
