"""Quality rules as one native projection: a table of thresholds compiled into Spark expressions, no user functions.

Words are runs of anything but space and U+0009 to U+000D. Repeated 5-word windows are found without a shuffle: each window's 64-bit
hash gives up its low bits to the window's place (an array has fewer than 2 ** 31), the packed numbers are sorted, and neighbours of equal hash are compared as words.
Windows of equal hash that differ from both neighbours are compared with all of their hash; there are hardly any.

Defined results: a null or empty text has no words and fails the base rules; every row is judged alone, so repeated rows get equal
results; a null doc_id stays null; very long texts are taken whole; an empty table gives an empty result; other columns are left out. Cost is n log n in a text's words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import whole_text

#: Common short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was for that with on this be are by from as at it or",
    "le la les de des du et est un une en que qui dans pour par sur au il elle",
    "der die das und ist von mit den dem ein eine zu im nicht auf für es sich auch an",
    "el los las y en que por con para una un se del no su al lo como más es",
)
BREAKS = "[\\x20\\x09-\\x0D]+"
#: Bits of a window's place.
PLACE_BITS = 31
#: Further bits of the hash to leave out; for tests of unequal windows with equal hashes.
HASH_LOSS = 0


@dataclass(frozen=True)
class Rule:
    """A row of the table: `value` is SQL over the base columns, in [low, high] for texts to keep; None: no bound."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        ok = F.lit(True)
        v = F.expr(self.value)
        if self.low is not None:
            ok = ok & (v >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (v <= F.lit(self.high))
        return F.coalesce(ok, F.lit(False))

    def sql(self) -> str:
        bounds = [f"{self.value} >= {self.low}"] * (self.low is not None) + [f"{self.value} <= {self.high}"] * (self.high is not None)
        return " AND ".join(bounds)


#: Kept are texts that pass all rows. Values are integers times constants, so that every engine agrees on them.
RULES = (
    Rule("fewest words", "n_words", low=10),
    Rule("mean word length, low", "word_chars - 2 * n_words", low=0),
    Rule("mean word length, high", "word_chars - 14 * n_words", high=0),
    Rule("symbols for each word", "10 * n_symbols - n_words", high=0),
    Rule("exclamations for each word", "4 * n_bangs - n_words", high=0),
    Rule("stop words", "100 * n_stop_words - 2 * n_words", low=0),
    Rule("repeated lines", "10 * n_dup_lines - 3 * n_lines", high=0),
    Rule("bullet lines", "10 * n_bullet_lines - 9 * n_lines", high=0),
    Rule("lines that break off", "10 * n_ellipsis_lines - 3 * n_lines", high=0),
)


def _repeat_words(size: int) -> dict[str, Column]:
    """Columns, to be added in this order, that end in n_repeat_words."""
    w = F.col("words")
    mask = (1 << PLACE_BITS) - 1
    none = F.expr("cast(array() as array<bigint>)")
    places = F.when(F.col("n_words") >= size, F.sequence(F.lit(0), (F.col("n_words") - size).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    hashed = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]).bitwiseAND(F.lit(~mask << HASH_LOSS))
    packed = F.sort_array(F.transform(places, lambda i: hashed(i).bitwiseOR(i.cast("long"))))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    alike = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
    twin = lambda x, y: alike(x, y) & (F.slice(w, place(x) + 1, F.lit(size)) == F.slice(w, place(y) + 1, F.lit(size)))
    beside = lambda a, f: lambda x, i: F.coalesce(f(x, F.get(a, i - 1)), F.lit(False)) | F.coalesce(f(x, F.get(a, i + 1)), F.lit(False))
    p, t, u = F.col("packed"), F.col("twins"), F.col("unlike")
    elsewhere = F.when(F.size(u) > 0, F.filter(u, lambda x: F.exists(t, lambda y: (x != y) & twin(x, y)))).otherwise(none)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    # Each window adds what lies beyond the end of those before it.
    covered = F.aggregate("repeats", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(size).cast("long"), i + size - a["end"])).alias("n"), (i + size).cast("long").alias("end")))
    return {
        "packed": packed,
        "twins": F.filter(p, beside(p, alike)),
        "unlike": F.filter(t, lambda x, i: ~beside(t, twin)(x, i)),
        "repeats": F.sort_array(F.transform(F.concat(F.array_except(t, u), elsewhere), place)),
        "n_repeat_words": covered["n"],
    }


def measure(docs: DataFrame, size: int = 5) -> DataFrame:
    """The base columns of each row."""
    stop = sorted({x for ws in STOP_WORDS for x in ws.split()})
    text = F.col("whole text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select("doc_id", whole_text().alias("whole text"))
    out = out.withColumns({"words": F.filter(F.split(text, BREAKS), lambda x: x != ""), "lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_bangs": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•‣]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long"),
            "n_stop_words": F.size(F.filter("words", lambda x: F.lower(x).isin(stop))).cast("long"),
        }
    )
    for name, value in _repeat_words(size).items():
        out = out.withColumn(name, value)
    return out.drop("whole text", "words", "lines", "packed", "twins", "unlike", "repeats")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base columns, base_failed and kept; `failed` names the rules that a text breaks."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.lit(True)
    for r in rules:
        verdict = verdict & r.passes()
    failed = F.concat(*[F.when(r.passes(), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit(r.name))) for r in rules])
    return measure(docs).withColumns({"base_failed": base_failed, "kept": ~base_failed & verdict, "failed": F.array_join(failed, ", ")})


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB's form of the query, by unnested words and window functions."""
    stop = ", ".join(f"'{x}'" for x in sorted({x for ws in STOP_WORDS for x in ws.split()}))
    ws = r"[\x20\x09-\x0D]"
    failed = " || ".join(f"CASE WHEN {r.sql()} THEN '' ELSE '{r.name}, ' END" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(list_filter(regexp_split_to_array(text, '{ws}+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '{ws}+'), lambda x: x <> ''), 1) AS i FROM d),
g AS (SELECT rid, i, word, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM c, range(5) t(k) GROUP BY rid),
ww AS (SELECT rid, count(*) AS n_words, count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words FROM w GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^{ws}*[-*•‣]')) AS n_bullet_lines, count(*) FILTER (regexp_matches(line, '(\\.\\.\\.|…){ws}*$')) AS n_ellipsis_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '{ws}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN ww USING (rid) LEFT JOIN ll USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {" AND ".join(r.sql() for r in rules)} AS kept,
  rtrim({failed}, ', ') AS failed FROM m"""
