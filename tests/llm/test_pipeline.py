"""The pipeline's stages against plain versions, each on its own input; and the registered queries on a small table."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import near_copies, quality
from folioforge.llm.common import tables_so_far
from folioforge.llm.queries import QUERIES

from . import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    rows = [(d, t, rng.choice(["en", "fr", None]), f"src{k % 3}", len(t or "")) for k, (d, t) in enumerate(brute.corpus(9, 80))]
    rows += [(2000 + k, " ".join(w + "###" for w in brute.words(rows[k][1])[:200]), "en", None, None) for k in range(30) if rows[k][1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    items = [(k, " ".join(brute.words(rows[5 * k][1])[3:25])) for k in range(4)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(k, f"https://h.example/{k}", f"<article><p>Text {k}</article>") for k in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]

    def after(name, docs):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).cache()
        assert out.columns == columns
        return out

    good = after("quality", docs)
    found = quality.verdict(quality.features(docs), quality.fit(quality.features(docs)))
    assert sorted(r[0] or -1 for r in rows_of(good)) == sorted(r.doc_id or -1 for r in found.filter("kept").collect())
    assert not any(brute.op8(t)[-1] for _, t in rows_of(good))

    lines = after("line_dedup", good)
    want = [(d, t) for d, _, n, t in brute.op9(rows_of(good)) if n == 0 or brute.words(t)]
    assert sorted(map(str, rows_of(lines))) == sorted(map(str, want))
    assert lines.filter(F.col("n_chars") != F.length("text")).count() == 0

    near = after("near_dedup", lines)
    got = rows_of(near)
    assert sorted(map(str, [r for r in got if r[0] is not None])) == sorted(map(str, brute.near_copies(rows_of(lines))))

    clean = after("decontamination", near)
    want = [d for d, *_, hit in brute.op10(rows_of(near), items) if not hit]
    assert sorted(map(str, want)) == sorted(str(d) for d, _ in rows_of(clean))
    assert len(want) < len(got)

    packed = corpus_pipeline.STAGES[-1][1](spark, clean, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in rows_of(clean)}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg(F.sum("length")).head()[0] == packed.agg(F.sum("length")).head()[0]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_return_their_columns(spark, sf_dir, name):
    want = {
        "op1": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2": "doc_id held_out lang_pred score", "op3": "doc_id n_assign n_access n_hex base_sha256 spans", "op4": "doc_id fingerprint component_id",
        "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6": "page_id url text n_chars", "op7": "doc_id n_words n_removed kept_sha256",
        "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9": "doc_id n_lines n_removed kept_sha256", "op10": "doc_id n_words n_hit n_items items_sha256 contaminated",
    }[name.split("_")[0]]
    found = QUERIES[name](spark, sf_dir)
    assert set(want.split()) <= set(found.columns)
    rows = found.collect()
    assert len(rows) >= (5 if name.startswith("op6") else 100)
    if "base_sha256" in found.columns:
        assert {r.base_sha256 for r in rows if not r.spans} <= {brute.sha("")}


def test_near_dedup_leaves_no_near_copy(spark, sf_dir):
    """Copies with a few words changed differ in more than two bits of a fingerprint."""
    rng = random.Random(4)
    w = [rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(200)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:50], "other", *w[51:]])), (3, " ".join([*w[:90], "other", *w[91:150], "words", *w[151:]])), (4, " ".join(reversed(w)))]
    docs = spark.createDataFrame([(*r, "en", None, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in rows_of(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir))) == [1, 4]


def test_near_dedup_fetches_the_texts_of_likely_copies_only(spark, monkeypatch):
    """Unlike texts that meet in many buckets make no texts move, and shuffle files and tables go."""
    rng = random.Random(6)
    phrases = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(5)) for _ in range(60)]
    texts = [" ".join(x for p in rng.sample(phrases, 12) for x in (p, str(rng.randrange(10**9)))) for _ in range(300)]
    texts += [f"{t} end" for t in texts[:5]] + texts[5:8]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string").repartition(3)
    sizes, materialize = {}, near_copies.materialize

    def counted(df, name):
        out = materialize(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    monkeypatch.setattr(near_copies, "_OFTEN", 10**9)  # as in a large table, where a sample doesn't show what is frequent
    since, name = tables_so_far(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    got = rows_of(near_copies.keep_one(docs))
    assert sorted(got) == sorted(brute.near_copies(rows_of(docs.distinct()))) == sorted(enumerate(texts[:300]))
    assert sizes["near-texts"] == 10
    assert sizes["shared-keys"] > 300 and sizes["near-links"] == 5
    assert tables_so_far() == since + 1 and spark.conf.get(name) == before


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    t, ruled_out = Fraction(4, 5), 0
    for _ in range(3000):
        n, changed, more = rng.integers(1, 700), rng.integers(0, 120), rng.integers(0, 120)
        x = rng.integers(-(2**63), 2**63, n)
        y = np.concatenate((x[changed:], rng.integers(-(2**63), 2**63, more)))
        if not len(y):
            continue
        both, may = max(0, n - changed), near_copies.may_be_similar(n, near_copies.bitmap(x), len(y), near_copies.bitmap(y), t)
        assert may or 5 * both < 4 * (n + len(y) - both)
        assert may == near_copies.may_be_similar(len(y), near_copies.bitmap(y), n, near_copies.bitmap(x), t)
        ruled_out += not may
    assert ruled_out > 1000


@pytest.mark.parametrize("table", ["documents", "benchmark"])
def test_pipeline_of_empty_tables(spark, sf_dir, tmp_path, table):
    for name in ("documents", "benchmark"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.limit(0) if name == table else df).write.parquet(f"{tmp_path}/{name}.parquet")
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n == 0 if table == "documents" else n > 20


def test_pipeline_keeps_columns_with_its_own_names(spark, sf_dir):
    """Columns named like the stages' own stay as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 40 or doc_id > 1990 or doc_id is null")
    own = ("__kept", "__doc", "__row", "__h", "__gone", "__copy", "__lines", "__removed", "__quality", "h", "quality")
    named = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, found = stage(spark, docs, sf_dir), stage(spark, named, sf_dir)
        assert found.columns == named.columns
        assert sorted(map(str, rows_of(found))) == sorted(map(str, rows_of(plain))), name
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in found.collect() for c in own), name


def test_tables_on_the_way_are_deleted(spark, sf_dir):
    from folioforge.llm import common

    since = common.tables_so_far()
    corpus_pipeline.run(spark, sf_dir)
    assert common.tables_so_far() == since + 1
