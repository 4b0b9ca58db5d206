"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import SPACES, UPPER, WORD_BREAK, free, let, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Common function words of the four languages.
STOP_WORDS = {
    "en": "the of and to a in is that for on with as be are this by at from or was it an",
    "fr": "de la le les des et en un une du que qui dans pour par sur avec au est",
    "de": "der die das und in den von zu ist mit ein eine im dem nicht auf sich des",
    "es": "el la los las de que y en un una por con para del se al es",
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text when scale * part compares (above or below) with limit * whole; all three are whole numbers."""

    name: str
    part: str
    whole: str
    scale: int
    above: int | None = None
    below: int | None = None

    def broken(self, of) -> Column:
        part, whole = of(self.part) * self.scale, of(self.whole)
        return part > whole * self.above if self.above is not None else part < whole * self.below

    def sql(self) -> str:
        sign, limit = (">", self.above) if self.above is not None else ("<", self.below)
        return f"{self.scale} * {self.part} {sign} {limit} * {self.whole}"


#: part and whole name measures of measured().
RULES = (
    Rule("word length, shortest mean", "word_chars", "n_words", 10, below=20),
    Rule("word length, longest mean", "word_chars", "n_words", 1, above=14),
    Rule("symbols to words", "n_symbols", "n_words", 10, above=2),
    Rule("capitals to letters", "n_capitals", "word_chars", 10, above=4),
    Rule("stop words to words", "n_stop_words", "n_words", 100, below=2),
    Rule("words like the word before to words", "n_same_words", "n_words", 10, above=3),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", 10, above=5),
    Rule("lines that end in an ellipsis", "n_open_lines", "n_lines", 10, above=5),
    Rule("bullet lines to lines", "n_bullet_lines", "n_lines", 10, above=9),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column, n: Column) -> Column:
    """Words in windows of WINDOW words found twice or more in the text.

    Windows are compared by a 64-bit hash of their words; sorting (hash, position) brings equal ones together.
    """
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda e, j: e["h"].eqNullSafe(F.get(s, j - 1)["h"]) | e["h"].eqNullSafe(F.get(s, j + 1)["h"]))
            return let(F.array_sort(F.transform(same, lambda e: e["i"])), spread)

        return let(pairs, twice)

    def spread(at: Column) -> Column:
        new = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.get(at, j + 1) - x))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= WINDOW, some).otherwise(F.lit(0).cast("long"))


def measured(text: Column) -> Column:
    """A struct of whole-number measures of a text."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})

    def of(words: Column, lines: Column) -> Column:
        n = F.size(words)
        fields = {
            "n_words": n,
            "word_chars": _without(text, SPACES),
            "n_symbols": F.length(text) - _without(text, SYMBOLS),
            "n_capitals": F.length(text) - _without(text, UPPER),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))),
            "n_same_words": F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_open_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-•*] "))),
            "n_repeat_words": _repeated(words, n),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in fields.items()))

    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(words, lambda ws: let(lines, lambda ls: of(ws, ls)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row per row of docs: doc_id, the measures, base_failed, kept, and broken (the names of the rules it breaks).

    A null or empty text has no words and so fails. Repeated rows are judged alike, each on its own; columns other
    than doc_id and text are not read. A text of any length is one row's work, in time n log n of its words. An empty table gives an empty one.
    """
    m = lambda k: F.col(f"m.{k}")
    failed = (m("n_words") < min_words) | (m("n_repeat_words") * 100 > m("n_words") * max_repeat_percent)
    names = F.filter(F.array(*(F.when(r.broken(m), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    out = texts(docs).select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*", failed.alias("base_failed"), names.alias("broken"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns whatever their names, by one projection and a filter.

    A null or empty text fails, repeated rows are judged alike, an empty table stays empty.
    """
    name = free(docs, "measured")
    m = lambda k: F.col(name)[k]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bad = (m("n_words") < min_words) | (m("n_repeat_words") * 100 > m("n_words") * max_repeat_percent)
    for r in rules:
        bad |= r.broken(m)
    return docs.withColumn(name, measured(text)).where(~bad).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    from aerolith.llm.common import table

    rows = judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    quote = lambda ws: ", ".join(f"'{w}'" for w in ws)
    stops = quote(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
c AS (SELECT r, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM t) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
  len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS n_same_words,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_open_lines,
  len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-•*] '))) AS n_bullet_lines,
  coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(r.sql() for r in RULES)}) AS kept FROM j"""
