"""Quality rules: length and repetition counts, then divergence from language references. DataFrame functions only.

Each text gives two histograms: its characters over eight classes, and its words over the common-word lists of the
languages plus one bin for all other words. The references are the same histograms summed over every labelled
document that passes the base rules, one per language that has at least ``min_docs`` of those documents, whatever its
share. The ``most`` commonest references are literals that every document is compared with; where there are more, a
document of another language is also compared with its own, which is joined. A document is rejected when the
Jensen-Shannon distance (square root of the divergence in bits) to the nearest reference exceeds a limit; texts under
the minimum lengths are too short to judge by divergence and stay, and so do texts labelled with a language that has
no reference.

Defined cases: null text counts as empty and fails the base rule (fewer than 20 words); a null label, or a table without
the label column, gives no reference, and such a document is compared with the references there are; without any
reference nothing is judged by divergence; very long texts are measured whole; repeated rows are judged alike and all
count for the references; references of equal size rank by label; an empty table gives an empty result. The input's
columns that are kept travel in one struct ``row``, so no name of theirs can clash; the label serves the references only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
#: Common words by language. Fixed values.
COMMON = {
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "ist", "im", "nicht", "ein", "eine", "als", "auch", "es", "an", "auf", "für", "dem", "des", "wird"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "are", "this", "or", "at", "from"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "avec"),
}
#: Character classes, removed one after the other, so each count sees only what is left of the text.
CLASSES = (
    ("c_ascii_lower", r"[a-z]+"),
    ("c_space", SPACE),
    ("c_letter", r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+"),
    ("c_upper", r"[\p{Lu}\p{Lt}]+"),
    ("c_digit", r"[0-9]+"),
    ("c_punct", r"[.,;:!?'\"()\-]+"),
    ("n_symbols", r"[#*$%&|<>]+"),
)
CLASS_BINS = [*(name for name, _ in CLASSES), "c_other"]
WORD_BINS = [*(f"w_{lang}" for lang in COMMON), "w_other"]
WINDOW = 8
#: Largest distances, least lengths that are judged, least documents of a reference, and the references that all are compared with.
CLASS_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_WORDS, MIN_DOCS, MOST = 0.29, 0.25, 250, 50, 10, 200


def _repeat_words(hashed: Column) -> Column:
    """Words inside windows that occur twice or more; ``hashed`` is sorted structs (h, i), null where none repeats."""
    n = F.size(hashed)
    pairs = F.zip_with(hashed, F.slice(hashed, F.lit(2), n), lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), b["h"].alias("after")))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(hashed, F.lit(1), n - 1))
    starts = F.sort_array(F.array_compact(F.zip_with(pairs, before, lambda a, b: F.when((a["h"] == a["after"]) | (a["h"] == b["h"]), a["i"]))))
    fold = F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("sum")), lambda s, x: F.struct(x.alias("at"), (s["sum"] + F.least(F.lit(WINDOW), x - s["at"])).alias("sum")))
    return F.coalesce(fold["sum"], F.lit(0)).cast("long")


def _among(words: str, names: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*names))).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), label: str = "lang") -> DataFrame:
    """row (the columns ``keep``), label, counts of the base rules, base_failed and both histograms, one row per document."""
    held = F.col(f"`{label}`").cast("string") if label in docs.columns else F.lit(None).cast("string")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), held.alias("label"), F.coalesce(F.col("text"), F.lit("")).alias("body_"))
    keep = ("row", "label")
    df = df.withColumns({"n_chars_": F.length("body_"), "words": F.array_remove(F.split("body_", SPACE), ""), "left0": F.regexp_replace("body_", CLASSES[0][1], "")})
    # every heavy column is named twice below, which keeps the optimizer from pasting it into a lambda
    common = sorted(set(sum(COMMON.values(), ())))
    lines = F.filter(F.split("body_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *keep, "n_chars_", "left0", F.size("words").cast("long").alias("n_words"), lines.alias("lines"),
        F.filter("words", lambda w: w.isin(common)).alias("common"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    df = df.select(
        *keep, "n_chars_", "left0", "n_words",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[_among("common", names).alias(f"w_{lang}") for lang, names in COMMON.items()],
        F.size("common").cast("long").alias("n_common"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("hashed"),
    )
    counts, left, at = {}, F.col("left0"), F.length("left0")
    counts[CLASSES[0][0]] = F.col("n_chars_") - at
    df = df.withColumn("n_repeat_words", F.when(F.col("hashed").isNull(), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("hashed")))).drop("hashed")
    for k, (name, pattern) in enumerate(CLASSES[1:], 1):
        df = df.withColumns({f"left{k}": F.regexp_replace(left, pattern, ""), f"at{k}": at})
        left, at = F.col(f"left{k}"), F.length(f"left{k}")
        counts[name] = F.col(f"at{k}") - at
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(
        *keep, "n_words", (F.col("n_chars_") - counts["c_space"]).cast("long").alias("word_chars"), "n_dup_lines", "n_repeat_words",
        *[counts[name].cast("long").alias(name) for name, _ in CLASSES], at.cast("long").alias("c_other"),
        *[f"w_{lang}" for lang in COMMON], (F.col("n_words") - F.col("n_common")).alias("w_other"), failed.alias("base_failed"),
    )


def references(measured: DataFrame, min_docs: int = 10) -> DataFrame:
    """label, n and the mean histograms ref_classes and ref_words of each language with at least ``min_docs`` documents."""
    used = measured.where(~F.col("base_failed") & F.col("label").isNotNull())
    sums = used.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CLASS_BINS + WORD_BINS]).where(F.col("n") >= min_docs)
    return sums.select("label", "n", _shares(CLASS_BINS).alias("ref_classes"), _shares(WORD_BINS).alias("ref_words"))


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def _divergence(p: Column, q: Column) -> Column:
    terms = F.zip_with(p, q, lambda a, b: _plogp(a) / 2 + _plogp(b) / 2 - _plogp((a + b) / 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def nearest_distance(shares: str, refs: list[list[float]]) -> Column:
    """Jensen-Shannon distance of a column of shares to the nearest reference; 0 without references or shares."""
    if not refs:
        return F.lit(0.0)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in refs])
    near = F.array_min(F.transform(table, lambda q: _divergence(F.col(shares), q)))
    return F.when(F.size(shares) > 0, F.sqrt(F.greatest(F.lit(0.0), near))).otherwise(F.lit(0.0))


def _shares(names: list[str]) -> Column:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in names])
    return F.when(total > 0, F.array(*[F.col(c) / total for c in names])).otherwise(F.array().cast("array<double>"))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), label: str = "lang", class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, most: int = MOST) -> DataFrame:
    """row (the columns ``keep``), base columns, js_classes, js_words (distance to the nearest reference) and kept."""
    measured, _ = staged(measure(docs, keep, label), "quality")
    found = references(measured, min_docs)
    common = found.orderBy(F.desc("n"), "label").limit(most + 1).collect()
    more, common = len(common) > most, common[:most]
    out = measured.withColumns({"p_classes": _shares(CLASS_BINS), "p_words": _shares(WORD_BINS)})
    near = {c: nearest_distance(f"p_{c}", [r[f"ref_{c}"] for r in common]) for c in ("classes", "words")}
    known = F.col("label").isNull() | F.col("label").isin([r.label for r in common])
    judged = out.where(known).withColumns({f"js_{c}": d for c, d in near.items()})
    if more:
        # languages beyond the commonest: their own reference is one more
        own = out.where(~known).join(found.drop("n"), "label", "left")
        rest = own.withColumns({f"js_{c}": F.when(F.col(f"ref_{c}").isNull(), 0.0).otherwise(F.least(d, F.sqrt(F.greatest(F.lit(0.0), _divergence(F.col(f"p_{c}"), F.col(f"ref_{c}")))))) for c, d in near.items()})
        out = judged.unionByName(rest.select(*judged.columns))
    else:
        out = out.withColumns({f"js_{c}": F.when(known, d).otherwise(0.0) for c, d in near.items()})
    chars = reduce(lambda a, b: a + b, [F.col(c) for c in CLASS_BINS])
    odd = ((chars >= min_chars) & (F.col("js_classes") > class_limit)) | ((F.col("n_words") >= min_words) & (F.col("js_words") > word_limit))
    return out.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality_columns(judged: DataFrame) -> DataFrame:
    """The digest of a judged table; distances to six digits."""
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("js_classes", 6).alias("js_classes"), F.round("js_words", 6).alias("js_words"))


def _oracle() -> str:
    """The same rules in DuckDB SQL."""
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    among = lambda names: f"len(list_filter(words, lambda x: x in ({quoted(names)})))"
    blank = r"[\x20\x09-\x0D]+"
    chain, before = [], "body"
    for k, (_, pattern) in enumerate(CLASSES):
        chain.append(f"c{k} as (select *, regexp_replace({before}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') as left{k} from {f'c{k - 1}' if k else 'd'})")
        before = f"left{k}"
    ends = ["body", *[f"left{k}" for k in range(len(CLASSES))]]
    counts = ", ".join(f"length({ends[k]}) - length({ends[k + 1]}) as {name}" for k, (name, _) in enumerate(CLASSES))
    plogp = lambda x: f"(case when {x} > 0 then {x} * log2({x}) else 0 end)"
    js = lambda bins: "sqrt(greatest(0, " + " + ".join(f"{plogp(f'p.p_{b}')} / 2 + {plogp(f'r.r_{b}')} / 2 - {plogp(f'((p.p_{b} + r.r_{b}) / 2)')}" for b in bins) + "))"
    total = lambda bins: "(" + " + ".join(bins) + ")"
    shares = lambda mark: ", ".join(f"coalesce({b} / nullif({total(bins)}, 0), 0) as {mark}_{b}" for bins in (CLASS_BINS, WORD_BINS) for b in bins)
    return f"""
    with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as body from documents),
    {", ".join(chain)},
    w as (select *, list_filter(regexp_split_to_array(body, '{blank}'), lambda x: x <> '') as words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from c{len(CLASSES) - 1}),
    places as (select rid, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w where len(words) > {WINDOW}),
    win as (select rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as h from places),
    twice as (select rid, i from win qualify count(*) over (partition by rid, h) > 1),
    step as (select rid, least({WINDOW}, i - coalesce(lag(i) over (partition by rid order by i), -{WINDOW})) as covers from twice),
    rep as (select rid, sum(covers)::bigint as n from step group by rid),
    m0 as (select w.rid, doc_id, lang, len(words)::bigint as n_words, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, {counts}, length({ends[-1]}) as c_other,
                  {", ".join(f"{among(names)} as w_{lang}" for lang, names in COMMON.items())}, len(words) - {among(sorted(set(sum(COMMON.values(), ()))))} as w_other, length(body) as chars from w left join rep on w.rid = rep.rid),
    m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m0),
    sums as (select lang, count(*) as n, {", ".join(f"sum({b}) as {b}" for b in CLASS_BINS + WORD_BINS)} from m where not base_failed and lang is not null group by lang having count(*) >= {MIN_DOCS}),
    refs as (select lang, row_number() over (order by n desc, lang) as place, {shares("r")}, {total(WORD_BINS)} as words_ from sums),
    p as (select *, {shares("p")} from m),
    near as (select p.rid, min({js(CLASS_BINS)}) as js_classes, min(case when words_ > 0 then {js(WORD_BINS)} end) as js_words from p join refs r on (r.place <= {MOST} or r.lang = p.lang) where p.lang is null or p.lang in (select lang from refs) group by p.rid),
    j as (select p.*, case when chars > 0 then coalesce(near.js_classes, 0) else 0 end as a, case when n_words > 0 then coalesce(near.js_words, 0) else 0 end as b from p left join near on p.rid = near.rid)
    select doc_id, n_words, (chars - c_space)::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not (chars >= {MIN_CHARS} and a > {CLASS_LIMIT}) and not (n_words >= {MIN_WORDS} and b > {WORD_LIMIT}) as kept, round(a, 6) as js_classes, round(b, 6) as js_words from j"""


ORACLE_SQL = _oracle()
