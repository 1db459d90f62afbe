import zlib

import numpy as np
import public_tokenizers
from test_decontam import WORD, lower
from test_similar import components
from test_suffix_dedup import brute as repeated, split
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline


def words_kept(text, drop):
    return [w for i, w in enumerate(split(text)) if i not in drop]


def brute_hits(text, items):
    w, hit = WORD.findall(lower(text)), set()
    for t in items:
        v = WORD.findall(lower(t))
        for p in range(max(1, len(v) - 9)) if v else []:
            win = v[p : p + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
    return hit


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    src = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(6).collect()]
    passage = " ".join(src[8][1].split()[:70])
    extra = [
        (900, src[5][1], "en", "src1", 1), (901, src[5][1], None, None, None), (902, None, "en", "s", 0), (903, "123 ?!", "en", "s", 6), (904, "", "en", "s", 0),
        (905, "A clean start here. " + passage + " and a clean end.", "fr", "s", 9), (906, "Before. " + items[2] + " After all.", "en", "s", 9), (907, items[3], "en", "s", 9), (908, "la " * 300, "es", "s", 9),
    ]
    docs = spark.createDataFrame(src + extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [(r[0], r[1]) for r in src + extra if r[1] and any(c.isalpha() for c in r[1])]
    component = components(sorted(rows))
    rows = [r for r in rows if component[r[0]] == r[0]]
    removable, _ = repeated(rows, 50)

    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.staged(f(spark, stage, str(tmp_path)))
        assert stage.columns == docs.columns
        seen.append({r["doc_id"]: r for r in stage.collect()})
    assert set(seen[0]) == {r[0] for r in src + extra} - {902, 903, 904}
    assert set(seen[1]) == {d for d, _ in rows} and {900, 901}.isdisjoint(seen[1])
    want = {d: words_kept(t, removable.get((d, t), ())) for d, t in rows}
    assert {d: split(r["text"]) for d, r in seen[2].items()} == {d: w for d, w in want.items() if w or (d, dict(rows)[d]) not in removable}
    assert all(seen[2][d]["text"] == t for d, t in rows if (d, t) not in removable)
    for d, r in seen[2].items():
        hit = brute_hits(r["text"], items)
        w = split(r["text"])
        left = [x for i, x in enumerate(w) if i not in hit]
        assert (d in seen[3]) == (bool(left) or not hit)
        if d in seen[3]:
            assert split(seen[3][d]["text"]) == left
            if not hit:
                assert seen[3][d] == r
            else:
                assert seen[3][d]["n_chars"] == len(seen[3][d]["text"])
    assert 907 not in seen[3] and 906 in seen[3]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    crc = {}
    for r in got:
        crc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(crc) == set(seen[3])
    for d, r in seen[3].items():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        assert sorted(crc[d])[0][0] == 0 and sum(n for _, n, _ in crc[d]) == len(ids)
        for a, n, c in crc[d]:
            assert zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c


def test_extra_columns_whose_names_clash(spark, sf):
    """Every stage keeps columns named as the operators' own."""
    names = ["score", "lang_pred", "row", "cuts", "n_words", "clean", "hashes", "set", "rep", "count"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 25")
    values = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names), F.col("text").alias("own text"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, sf)
        assert got.columns == extra.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names) and all(r["own text"] == values[r["doc_id"]] for r in rows)
    assert corpus_pipeline.pack_sequences(spark, extra, sf).count() >= 25


def test_repeated_ids_and_nulls_in_near_dedup(spark, sf):
    """Two texts under one id are two texts; the survivor is the same however rows are dealt."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, b + " more", "x"), (3, a, "x"), (None, a, "x"), (None, None, "x"), (4, None, "q"), (5, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 5):
        got = sorted((tuple(r) for r in corpus_pipeline.near_dedup(spark, docs.repartition(parts), sf).collect()), key=str)
        assert got == sorted([(1, a, "x"), (1, b, "y"), (None, a, "x"), (None, None, "x"), (4, None, "q")], key=str)


def test_language_stage_drops_what_cannot_be_told(spark, sf):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the and with of the and", "en")] * 9 + [("der die und das nicht der", "de")] * 9 + [(None, "en"), ("", "de"), ("12 ?", None), ("日本語文字", None), ("the", None)])], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    assert got == set(range(18)) | {22}


def test_empty_documents(spark, sf, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
