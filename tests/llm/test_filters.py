import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratakit.llm import langid, lines, quality, queries, urls, warc
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


CASES = [None, "", " \n ", "a " * 30, "x y z\nx y z\n\nx y z ", " ".join(map(str, range(40))), "1 2 3 4 5 6 7 8 9 " * 3, "#*$%&|<> é日本 \x0b\x0c ok", "l\n" * 50, " ".join(f"w{k}" for k in range(30)) + " " + " ".join(f"w{k}" for k in range(9)), "z" * 100_000, " ".join(f"v{k % 977}" for k in range(30_000))]


def test_quality_counts(spark):
    df = spark.createDataFrame([(k, t, "en", 1, True) for k, t in enumerate(CASES)], "doc_id long, text string, lang string, n_words int, kept boolean")
    for r in quality.quality_columns(quality.judge(df)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(CASES[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id])
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert sum(r.kept for r in rows if r.doc_id in bad) <= 0.2 * max(1, len(bad))


def test_quality_distance_against_numbers(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    df = spark.createDataFrame([(p,), ([],)], "p array<double>")
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    got = [r[0] for r in df.select(quality.nearest_distance("p", [q, [1.0, 0.0, 0.0]])).collect()]
    assert got[0] == pytest.approx(min(math.sqrt((kl(p, m) + kl(q, m)) / 2), 10)) and got[1] == 0
    assert [r[0] for r in df.select(quality.nearest_distance("p", [])).collect()] == [0, 0]


def test_quality_empty_and_unlabelled(spark):
    schema = "doc_id long, text string, lang string"
    assert quality.judge(spark.createDataFrame([], schema)).count() == 0
    row = quality.judge(spark.createDataFrame([(None, "word " * 3 + " ".join(f"q{k}" for k in range(60)), None)], schema)).first()
    assert row.kept and row.js_classes == 0
    assert quality.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first().kept is False


CLASHES = ["lines", "n_words", "w_en", "hashed", "words", "left0", "kept", "p_words", "Label", "body_", "n_chars_", "js_words", "n", "row", "windows", "common", "base_failed", "c_space", "at1"]


def test_quality_clashing_names(spark):
    rows = [(k, t, "en") for k, t in enumerate(CASES)]
    plain = quality.quality_columns(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()
    df = spark.createDataFrame([(*r, *[f"v{r[0]}"] * len(CLASHES)) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES))
    judged = quality.judge(df, tuple(df.columns))
    assert sorted(quality.quality_columns(judged).collect()) == sorted(plain)
    back = judged.select("row.*")
    assert back.columns == df.columns and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_quality_keeps_a_small_language(spark):
    """Four Italian documents among a thousand others are kept, as they are among six hundred."""
    import random

    rng = random.Random(9)
    speak = lambda common, letters: " ".join(w for _ in range(40) for w in (rng.choice(common), "".join(rng.choice(letters) for _ in range(6))))
    for many in (600, 1000):
        rows = [(speak(quality.COMMON["en"], "abcdefghij"), "en") for _ in range(many)] + [(speak(("il", "di", "che", "non", "si", "una", "per", "con"), "aeioumnprt"), "it") for _ in range(4)]
        got = quality.judge(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")).where("kept").count()
        assert got == len(rows)


def test_quality_rare_languages(spark):
    """A language of 12 documents among 2,512 has its reference, one of 3 is not judged; symbols are still rejected."""
    import random

    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    english = lambda: " ".join(w for _ in range(30) for w in (rng.choice(quality.COMMON["en"]), word("abcdefghij")))
    foreign = lambda letters: " ".join(word(letters) for _ in range(60))
    rows = [(english(), "en") for _ in range(2500)] + [(foreign("абвгдежзик"), "ru") for _ in range(12)] + [(foreign("αβγδεζηθικ"), "el") for _ in range(3)] + [(foreign("#*$%&|<>"), "en")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    for options in ({}, {"most": 1}):
        got = quality.judge(df, **options).collect()
        assert len(got) == len(rows) and sorted(r.row.doc_id for r in got if not r.kept) == [len(rows) - 1]
        assert all(r.js_classes == 0 for r in got if r.label == "el")


def test_native_plans_hold_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en")], "doc_id long, text string, lang string")
    for df in (quality.judge(docs), lines.dedup_lines(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    columns, rows = rows_of(queries.QUERIES[name](spark, SF))
    assert rows == sql_rows(queries.ORACLE_SQL[name], SF, columns)


def test_lines(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    texts = {
        1: f"Posted by user 12 today ok\nown text of one here\n{long}", 2: f"Posted by user 99 today ok\n{long}\nanother own text two", 3: "Posted by user x7 today ok\nsome third text here", 4: None, 5: "", 6: "short one\nshort one",
        7: "short one", 8: "short one", 9: "same line in two\nown text of one there", 10: "same line in two", 11: "Copyright holder is Alpha and all rights stay reserved here", 12: "Copyright holder is Beta and all rights stay reserved here", 13: "Copyright holder is Gamma and all rights stay reserved here",
    }
    df = spark.createDataFrame([(k, t, "u", 1) for k, t in texts.items()] + [(None, "Posted by user 5 today ok", "u", 1)], "doc_id long, text string, leaf string, n int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(df).collect()}
    assert got[1] == (texts[1], 3, 0)
    assert got[2] == ("another own text two", 3, 2)  # the template and the long passage, which two documents suffice for
    assert got[3] == ("some third text here", 2, 1)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[None][2] == 0
    assert got[6][2] == got[8][2] == got[9][2] == 0 and got[10] == ("", 1, 1)  # lines under four words stay
    assert got[11][2] == 0 and got[12] == ("", 1, 1) and got[13] == ("", 1, 1)  # one variable field without a digit
    assert lines.dedup_lines(df.where("doc_id > 99")).count() == 0


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.n_dropped for r in lines.dedup_lines(df).orderBy("doc_id").collect()]


NAMES = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")


def test_lines_several_templates_in_a_leaf(spark):
    one = [f"Copyright holder is {w} and all rights stay reserved here for good" for w in NAMES]
    two = [f"Copyright holder is {w} and all rights stay reserved here for {w}x" for w in NAMES]
    other = [f"Copyright holder is what you never think of at all {w} friend" for w in NAMES]
    stray = "Copyright holder is one that no other line here looks like at"
    assert all(len(x.split()) == 12 for x in [*one, *two, *other]) and len(stray.split()) == 12
    assert dropped(spark, one) == dropped(spark, two) == [0, 1, 1, 1, 1, 1]
    assert dropped(spark, [*one, stray]) == [0, 1, 1, 1, 1, 1, 0]
    # two templates and a stray line in one leaf, and copies in the other order
    assert dropped(spark, [*one, stray, *other]) == [0, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 1]
    assert dropped(spark, [stray, *other, *one]) == [0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1]
    # four of twelve words differ: no template
    assert dropped(spark, [f"Copyright holder is {w} and {w}a rights {w}b reserved here for {w}c" for w in NAMES]) == [0] * 6


def test_lines_every_pair(spark):
    """lines that are alike but agree in no whole block, or only with a line that is not the least of its block."""
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = []
    for n in (8, 9, 11, 16, 30, 43):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(14):
            edits = set(rng.sample(range(3, n), rng.randrange(1, n // 4 + 2)))
            texts.append(" ".join(rng.choice(words) + "x" if k in edits else w for k, w in enumerate(base)))
    # every block of eight places differs in one, so 35 of 43 are equal
    texts += [" ".join([*words[:3], *(w + "y" if k % 5 == 2 else w for k, w in enumerate(words[3:43]))]), " ".join(words[:43])]
    rows = [x.split(" ") for x in texts]
    up = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if len(a) == len(b) and a[:3] == b[:3] and sum(x == y for x, y in zip(a, b, strict=True)) >= 0.75 * len(a):
                up = [up[j] if g == up[i] else g for g in up]
    first = {g: up.index(g) for g in up}
    want = [int(k != first[g]) for k, g in enumerate(up)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.n_dropped for r in lines.dedup_lines(df, every_pair=True).orderBy("doc_id").collect()]
    assert got == want and want[-2:] == [0, 1] and dropped(spark, texts)[-2:] == [0, 0]


def test_lines_of_a_broken_passage(spark):
    """A passage of 60 words in lines of six, in two documents."""
    passage = "\n".join(" ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(6)) for k in range(10))
    assert dropped(spark, [f"own start of the first\n{passage}", f"quite another start here\n{passage}\nand its own end too"]) == [0, 10]


def test_lines_clashing_names_repeats_and_long_texts(spark):
    long = "\n".join(f"line number x{chr(97 + k % 26)} of {'y' * (k % 40)} in a very long text {k % 7}" for k in range(30_000)) + "\nshared line at the very end"
    rows = [(1, "shared line at the very end"), (2, long), (3, "shared line at the very end\nown"), (3, "shared line at the very end\nown"), (3, "else entirely"), (4, None)]
    names = ["lines", "gone", "row", "of", "pos", "line", "first", "drop_keys", "kept_", "lines_", "N_lines", "n_dropped"]
    df = spark.createDataFrame([(*r, *[f"v{r[0]}"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    kept = {k: [t for d, t in got if d == k] for k in range(1, 5)}
    assert kept[1] == [rows[0][1]] and kept[3] == ["else entirely", "own", "own"] and kept[4] == [None]
    assert kept[2][0] == long.removesuffix("\nshared line at the very end")
    assert all(r[n] == f"v{r.doc_id}" for r in out.collect() for n in names)


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def naive(train_rows, texts, bits=15, alpha=0.5):
    """(language, score, fit) by multinomial naive Bayes over the same features, with plain integers and dictionaries."""
    primes = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)

    def grams(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
        raw = re.sub(rb" +", b" ", raw)
        for n in range(1, 5):
            for i in range(len(raw) - n + 1):
                key = 0
                for b in raw[i : i + n]:
                    key = (key * 257 + b) & 0xFFFFFFFF
                yield ((key ^ (key >> 15)) * primes[n - 1] & 0xFFFFFFFF) >> (32 - bits)

    counts, docs = {}, Counter()
    for text, label in train_rows:
        counts.setdefault(label, Counter()).update(grams(text))
        docs[label] += 1
    totals = {label: sum(c.values()) + alpha * 2**bits for label, c in counts.items()}
    shares = {label: [(c[g] + alpha) / totals[label] for g in range(2**bits)] for label, c in counts.items()}
    usual = {label: sum(p * math.log(p) for p in share) for label, share in shares.items()}
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0, None))
            continue
        found = Counter(grams(text))
        own = {label: sum(n * math.log((counts[label][g] + alpha) / totals[label]) for g, n in found.items()) for label in sorted(counts)}
        joint = {label: math.log(docs[label] / sum(docs.values())) + x for label, x in own.items()}
        best = max(sorted(joint), key=joint.get)
        out.append((best, 1 / sum(math.exp(v - joint[best]) for v in joint.values()), own[best] / sum(found.values()) - usual[best]))
    return out


def test_langid_against_plain_numbers(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    learned = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text and any(c.isalpha() for c in r.text)]
    want = dict(zip([r.doc_id for r in rows], naive(learned, [r.text for r in rows]), strict=True))
    for r in queries.op4_language_id(spark, SF).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-3), r.doc_id
        assert (r.fit is None) == (want[r.doc_id][2] is None) and (r.fit is None or r.fit == pytest.approx(want[r.doc_id][2], abs=1e-3)), r.doc_id


def test_langid_cases(spark):
    rows = [(k, t, lang, 0.5, "x") for k, (t, lang) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("the cat", "en"), (None, "en"), ("123 ---", None), ("", None), ("und die", None), ("É" * 3_000_000, None), ("the cat and the dog " * 5, "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, row string")
    model = langid.train(df)
    assert model.names == ["de", "en"]
    out = langid.identify(df, model)
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert (got[0][0], got[1][0], got[6][0]) == ("en", "de", "de") and got[3] == got[4] == got[5] == ("und", 0.0)
    assert out.select("row.*").columns == df.columns and {(r.score, r.row) for r in out.select("row.*").collect()} == {(0.5, "x")}
    none = langid.train(df.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.predict_documents(df.where("doc_id > 99")).count() == 0
    assert langid.train(df, model_bytes=1 << 15).bits == 12


def test_langid_pieces_lose_nothing(monkeypatch):
    text = "the cat and the dog, und der Hund É  über " * 3000
    view = langid.utf8_view(langid.pa.array([text, "a b", text, None, text]))
    gather = lambda: [Counter(zip([i + o for o in owner.tolist()], found.tolist(), strict=True)) for i, _, found, owner in langid.gram_blocks(*view, 15)]
    whole = sum(gather(), Counter())
    monkeypatch.setattr(langid, "_BLOCK", 1000)
    pieces = gather()
    assert len(pieces) > 50 and sum(pieces, Counter()) == whole


def test_rows_in_no_language_go(spark):
    import random

    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("qxzjkvwyp") for _ in range(6)) for _ in range(40))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6, noise, "en"), (10**6 + 1, noise, "tlh"), (10**6 + 2, noise, None), (10**6 + 3, noise[:50], None), (10**6 + 4, "12 34 " * 50, "en"), (10**6 + 5, None, "en")], docs.schema)
    model = langid.train(docs.where(~langid.held_out()))
    kept = [r.doc_id for r in langid.in_a_language(docs.unionByName(extra), model).collect()]
    assert {k for k in kept if k >= 10**6} == {10**6 + 1, 10**6 + 3}
    assert len(kept) - 2 >= 0.99 * docs.count()
    none = langid.in_a_language(extra, langid.Model.from_counts({}, 15))
    assert {r.doc_id for r in none.collect()} == {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3}


def payload_digest(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def check_pages(rows, pages):
    first = {}
    for k, html in pages:
        raw = (html or "").encode()
        if k is not None:
            first[raw] = min(k, first.get(raw, k))
    want = []
    for k, html in pages:
        raw = (html or "").encode()
        f = first.get(raw)
        revisit = f is not None and f != k
        want.append((k, len(raw), payload_digest(raw), "revisit" if revisit else "response", f if revisit else None))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)


def test_warc(spark, tmp_path):
    pages = [(5, "<p>é"), (3, "<p>é"), (9, None), (2, ""), (7, ""), (None, "<p>é"), (11, "x\r\n\r\nWARC/1.1\r\n\x00" * 9), (2**53 + 1, "x" * 3_000_000), (3, "<p>é"), (12, "\x00" * 50)]
    df = spark.createDataFrame([(k, "http://a b/\n" if k == 5 else None, h, "z") for k, h in pages], "page_id long, url string, html string, sha string").repartition(3)
    check_pages(warc.round_trip(df).collect(), pages)
    warc.write_archives(df, str(tmp_path / "w"), records_per_file=2)
    back = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()
    assert {bytes(r.payload) for r in back if r.record_type == "response"} == {(h or "").encode() for _, h in pages}
    assert len(list((tmp_path / "w").rglob("part*"))) > 3
    import gzip

    for p in (tmp_path / "w").rglob("part*"):
        assert gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(df.where("page_id = -1")).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    import random

    rng = random.Random(2)
    pages = [(k, bytes(rng.randrange(33, 127) for _ in range(rng.choice((100, 30_000)))).decode()) for k in range(120)]
    df = spark.createDataFrame([(k, f"http://h/{k}", h, 7) for k, h in pages], "page_id long, url string, html string, roll int").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), file_bytes=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part*")]
    assert len(sizes) > 8 and max(sizes) < 100_000 + 32_000
    check_pages(warc.read_archives(spark, str(tmp_path / "w")).collect(), pages)


def test_warc_minimum_size(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.round_trip(df, min_bytes=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_damage_is_found():
    raw = warc.record(1, "http://x/", b"hello", None)
    data = warc.member(raw) + warc.member(b"")
    assert data[-1] == 0 and [x for x in warc.members(data, 7) if x] == [raw]
    assert warc.read_record(raw)["payload"] == b"hello"
    for broken in (raw.replace(b"hello", b"hullo"), raw[:-5], raw.replace(b"WARC/1.1", b"WARK/1.1"), raw.replace(b"\r\nhello", b"\r\nhello!")):
        with pytest.raises(ValueError):
            warc.read_record(broken)
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(warc.members(data[:-30]))
    import random

    noise = bytes(random.Random(1).randrange(256) for _ in range(17 << 10)) * 1024
    assert len(noise) >= 1 << 24 and warc.member(noise)[-1] == 0 and b"".join(warc.members(warc.member(noise))) == noise


def test_warc_whole_table(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    check_pages(queries.op7_warc(spark, SF).collect(), pages)


def test_urls(spark):
    rows = {
        1: None, 2: "", 3: "no scheme/net", 4: "http://A.Example.NET/en/x?y", 5: "http://example.net/de/", 6: "http://x.net", 7: "http://x.net/", 8: "https://example.com/de/1#a", 9: "http://notexample.com/de/1", 10: "x://b.org/fr/#f", 11: "http://b.org/fr",
        12: "http://m.spam-farm.example.org/a", 13: "http://ÉX.org?x://y.net/", 14: "://example.net/en/", 15: "http://net/", 16: "http://a.org://b.net/", 17: "http://www.casino-win.example.com/de/x", 18: "http://a.org/fr/\nx", 19: "http://x.d199999.ads.example/", 20: "http://d200000.ads.example/", 21: "http://spam-farm.example.org.evil.com/", 22: "http://" + "a." * 5000 + "free-bets.example.com/", 23: "http://a..adult-zone.example.com./",
    }
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in rows.items()], "page_id long, url string, host string, verdict string")

    def want(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(s + p, v) for s, p, v in urls.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if re.search(urls.LISTED_PATTERN, host) else "allow")
        return host, path, rule, verdict

    listed = urls.production_list(spark)
    for options in ({}, {"shard_keys": 3, "batch_bytes": 40}):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, listed, **options).collect()}
        assert got == {k: want(u) for k, u in rows.items()}
    assert urls.filter_urls(df.where("page_id > 99"), listed).count() == 0
    assert {r.in_list for r in urls.filter_urls(df, listed.where("domain is null")).collect()} == {False}
    far = spark.createDataFrame([(2**53 + 1, "http://a.b/"), (None, "http://spam-farm.example.com")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(far, listed).collect()} == {2**53 + 1: "allow", None: "block"}


def test_urls_with_a_long_list(spark):
    """A list of 300,000 domains, half of which occur, among 400,000 hosts: several shards and passes, exact."""
    pages = spark.range(400_000).selectExpr("id as page_id", "concat('http://www.h', id, '.site', id % 7, '.example/') as url")
    listed = spark.range(300_000).selectExpr("case when id % 2 = 0 then concat('H', id, '.site', id % 7, '.example') else concat('absent', id, '.example') end as domain")
    out = urls.filter_urls(pages, listed, shard_keys=150_000, batch_bytes=100_000)
    want = F.col("page_id") % 2 == 0
    assert out.where(F.col("in_list") != (want & (F.col("page_id") < 300_000))).isEmpty() and out.count() == 400_000


def test_cascade_is_exact():
    inside, outside = [f"in{k}" for k in range(3000)], [f"out{k}" for k in range(20000)]
    c = urls.Cascade.from_bytes(urls.Cascade.build(inside, outside, 0.2).to_bytes())
    assert len(c.levels) > 2 and c.contains(inside).all() and not c.contains(outside).any()
    assert not urls.Cascade.build([], outside).contains(outside).any() and urls.Cascade.build(inside, []).contains(inside).all()
    assert sum(len(p) for _, _, p in c.levels) * 8 < 16 * len(inside)
