"""Operator 8: quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores, per document, the measurements
and one failure bit per rule.  A policy is a versioned mask of rules: applying
one, changing it or finding what each rule costs (``ablations``) reads the ledger
alone, by bitwise operations, never the texts again.

One scan, no shuffle: all measurements are expressions on the row.  Repeated
three-word windows are found by sorting one packed number per window (hash and
place) and comparing the words of neighbours; if a hash was shared by unequal windows,
or a text has more than 2^24 words, the windows themselves are sorted instead.

Defined results: null and empty texts have no words (and fail the word count);
repeated rows are judged alike, one result each; an empty table gives no rows.
Other columns are carried or dropped by the caller, whatever their names.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moldwatch.llm.text import token_array

PLACE_BITS = 24


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[], Column]  # over the measurement columns


MEASURES = ["n_words", "word_chars", "n_upper", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

RULES = [
    Rule(0, "too_few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "symbols", lambda: 100 * F.col("n_symbols") > 10 * F.col("n_words")),
    Rule(3, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(4, "long_words", lambda: F.col("word_chars") > 14 * F.col("n_words")),
    Rule(5, "shouting", lambda: 100 * F.col("n_upper") > 50 * F.col("word_chars")),
    Rule(6, "duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
]
BASE_MASK = 0b0000011
#: Policies by version: the rules whose failure rejects a document.
POLICIES = {"v1": 0b0000111, "v2": 0b1111111}
POLICY = "v2"


def _windows_found_twice(tokens: Column, n: Column, packed: Column) -> Column:
    """Sorted distinct starts of the three-word windows found twice or more."""

    def same(a, b):
        return F.get(tokens, a).eqNullSafe(F.get(tokens, b)) & F.get(tokens, a + 1).eqNullSafe(
            F.get(tokens, b + 1)) & F.get(tokens, a + 2).eqNullSafe(F.get(tokens, b + 2))

    def neighbours(ordered, key_equal, place):
        pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))),
                           lambda a, b: F.when(key_equal(a, b), F.struct(place(a).alias("a"), place(b).alias("b"))))
        return F.filter(pairs, lambda p: p.isNotNull())

    mask = (1 << PLACE_BITS) - 1
    hashed = neighbours(packed, lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS),
                        lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    whole = F.sort_array(F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.get(tokens, i).alias("x"), F.get(tokens, i + 1).alias("y"), F.get(tokens, i + 2).alias("z"),
                           i.alias("at"))))
    exact = neighbours(whole, lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), lambda x: x["at"])
    unsure = (n > mask) | F.exists(hashed, lambda p: ~same(p["a"], p["b"]))
    pairs = F.when(unsure, exact).otherwise(hashed)
    return F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))))


def _covered(starts: Column) -> Column:
    """Words inside the three-word windows at these starts."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["words"] + s + 3 - F.greatest(a["upto"], s)).alias("words"), (s + 3).alias("upto")),
        lambda a: a["words"])


def ledger(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with a struct ``ledger``: the measurements and
    fail_bits."""
    rules = RULES if rules is None else rules
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), t.alias("text"), token_array(t).alias("tokens"))
    d = d.select("row", "text", "tokens", F.size("tokens").alias("n"))
    packed = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get("tokens", i), F.get("tokens", i + 1), F.get("tokens", i + 2)),
                              PLACE_BITS).bitwiseOR(i.cast("bigint"))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("row", "text", "tokens", "n", F.when(F.col("n") >= 3, packed).alias("packed"), lines.alias("lines"))
    measures = F.struct(
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("packed").isNull(), 0).otherwise(
            _covered(_windows_found_twice(F.col("tokens"), F.col("n"), F.col("packed")))).cast("bigint").alias("n_repeat_words"))
    # A one-row inline: a filter on the verdict then stays above it, instead of being pushed
    # down with a copy of these expressions for each rule.
    d = d.select("row", F.inline(F.array(measures)))
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits + F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint")
    return d.select("row", F.struct(*MEASURES, bits.alias("fail_bits")).alias("ledger"))


def passes(bits: Column, mask: int) -> Column:
    """Whether a policy's mask lets a document pass."""
    return bits.bitwiseAND(F.lit(mask).cast("bigint")) == 0


def ablations(entries: DataFrame, mask: int, rules: list[Rule] | None = None) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if it were
    left out.  ``entries`` has fail_bits.  At most 2^rules combinations leave the first
    aggregation."""
    used = [r for r in (RULES if rules is None else rules) if mask >> r.bit & 1]
    combos = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in used)))
    x = combos.select("bits", "docs", each.alias("r")).select("bits", "docs", "r.rule", "r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("docs")).otherwise(0)).alias
    return x.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        total(F.col("bits") == F.col("bit"))("n_failed_alone"),
        total((F.col("bits").bitwiseAND(F.bitwise_not("bit"))) == 0)("kept_without"))


def op8_quality(spark, sf_dir):
    """Contract query: the ledger and verdict of all ``documents``."""
    d = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    bits = F.col("ledger.fail_bits")
    return d.select("row.doc_id", *(f"ledger.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    (~passes(bits, BASE_MASK)).alias("base_failed"), passes(bits, BASE_MASK | POLICIES[POLICY]).alias("kept"),
                    "ledger.n_upper", "ledger.n_lines", "ledger.fail_bits")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(li.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(li.n - li.u, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN li USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
    + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 14 * n_words)::INT + 32 * (100 * n_upper > 50 * word_chars)::INT
    + 64 * (100 * n_dup_lines > 60 * n_lines)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
    (fail_bits & 127) = 0 AS kept, n_upper, n_lines, fail_bits FROM f
"""
