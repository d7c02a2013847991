import hashlib
import random
import re
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from stratakit.llm import lines, quality, tokens
from stratakit.session import staged
from tests.llm.test_filters import naive
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


def noise(rng, words=45):
    """Too short to be judged by its words, in letters that no language has in such order."""
    return " ".join("".join(rng.choice("qxzjkvwyp") for _ in range(6)) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    """A small table of the usual kind, and documents for each stage to reject."""
    rng = random.Random(3)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    clean = table.where("n_chars > 800 and lang = 'en'").orderBy("doc_id").first().text.replace("\n", " ")
    words = clean.split(" ")
    near = " ".join("changed" if k % 60 == 30 else w for k, w in enumerate(words))
    planted = [noise(rng), None, "", "12 34 " * 40, "#$% " * 90, f"one more start of {clean}", f"another start of {near} and an end"]
    rows = [(10**6 + k, t, "en", "s", len(t or "")) for k, t in enumerate(planted)]
    return staged(table.unionByName(spark.createDataFrame(rows, table.schema)).coalesce(4), "docs")[0]


def by_sql(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return con.sql(sql).fetchall(), [c for c in con.sql(sql).columns]


def test_stages_against_plain_versions(spark, docs):
    """Each stage's rows are those of its SQL twin or of a plain version, on all that the stage before kept."""
    frames = [docs]
    for _, stage in pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], SF), "t")[0])
    assert all(df.columns == docs.columns for df in frames[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in frames]
    rows, names = by_sql(docs, quality.ORACLE_SQL)
    assert ids[1] == {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    kept = frames[1].collect()
    learned = [(r.text, r.lang) for r in kept if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and any(c.isalpha() for c in r.text)]
    found = naive(learned, [r.text for r in kept])
    known = {label for _, label in learned}
    want = {r.doc_id for r, (lang, _, fit) in zip(kept, found, strict=True) if lang != "und" and (fit >= -1.8 or len(r.text) < 100 or (r.lang is not None and r.lang not in known))}
    assert ids[2] == want and 10**6 in ids[1] - ids[2]
    rows, names = by_sql(frames[2], lines.ORACLE_SQL)
    md5 = {r[names.index("doc_id")]: r[names.index("text_md5")] for r in rows}
    lined = {r.doc_id: r for r in frames[3].collect()}
    assert all(hashlib.md5(r.text.encode()).hexdigest() == md5[k] and r.n_chars == len(r.text) for k, r in lined.items())
    assert len(ids[2] - ids[3]) == sum(1 for k, v in md5.items() if k not in lined) < len(ids[2]) / 2
    links = brute([(k, r.text) for k, r in lined.items()])
    assert ids[4] == {k for k, (_, c) in links.items() if c == k}
    texts = {r.doc_id: r.text for r in frames[4].collect()}
    check_pieces(frames[5].collect(), Tokenizer.from_file(tokens.default_path()), texts)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    failed = {r.doc_id for r in quality.judge(docs).where("base_failed").select("row.doc_id").collect()}
    assert len(good & ids[2]) >= 0.99 * len(good - failed)


def test_run_writes_what_the_stages_give(spark):
    whole = pipeline.run(spark, SF)
    rows = whole.collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(whole.columns) and rows
    assert sum(r.length for r in rows) == sum(n for _, n in {(r.doc_id, r.doc_tokens) for r in rows})


ODD = ["kept", "row", "lines", "n_lines", "n_dropped", "lang_pred", "score", "fit", "of", "h1", "n", "component", "words", "left0", "label", "gone", "start", "part"]


def test_odd_rows_and_clashing_names(spark, docs):
    """Nulls in any column, empty and repeated rows, one id with two texts, extra columns: kept as they are or dropped as stated."""
    clean = [r.text for r in docs.where("n_chars > 600 and doc_id < 1000000 and lang = 'en'").orderBy("doc_id").limit(40).collect()]
    clean = list(dict.fromkeys(clean))
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(clean)] + [(0, clean[0], "en", "s", 1), (1, clean[2], None, None, None), (None, clean[3], None, None, None), (None, None, None, None, None), (90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, " \n ", None, "s", None)]
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    plain = spark.createDataFrame(rows, schema)
    odd = plain.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, -1)) as {c}" for c in ODD])
    for name in ("quality rules", "language ID", "line dedup", "n-gram Jaccard join"):
        out = staged(STAGES[name](spark, odd, ""), "t")[0]
        assert out.columns == odd.columns, name
        got = out.collect()
        assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in got for c in ODD), name
        base = sorted(((r.doc_id, r.text) for r in STAGES[name](spark, plain, "").collect()), key=str)
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == base, name
        ids = [k for k, _ in base]
        if name == "n-gram Jaccard join":
            assert ids.count(0) == 1 and {90, 91, 92} <= set(ids) and ids.count(None) == 2
        else:
            assert not {90, 91, 92} & set(ids), name
    packed = STAGES["packing"](spark, odd, "")
    assert packed.select("doc_id").distinct().count() == plain.select("doc_id").distinct().count()


def test_empty_table(spark, docs):
    empty = docs.where("doc_id < 0")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_very_long_text(spark, docs):
    """A text of 3 MB goes through all stages whole."""
    some = docs.where("lang = 'en' and n_chars > 500 and doc_id < 1000000")
    rng = random.Random(1)
    words = sorted({w for r in some.limit(30).collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)})
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(40_000))
    df = some.unionByName(spark.createDataFrame([(10**7, long, "en", "s", len(long))], docs.schema)).select(*docs.columns)
    out = df
    for name in ("quality rules", "language ID", "line dedup", "n-gram Jaccard join"):
        out = staged(STAGES[name](spark, out, ""), "t")[0]
    row = out.where("doc_id = 10000000").first()
    assert row.n_chars > 0.9 * len(long)
