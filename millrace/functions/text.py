"""Column functions over texts, costs, judge answers and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper word counts (exclusive) and names of the length buckets.
BUCKETS = ((2000, "xs"), (8000, "s"), (20000, "m"), (50000, "l"), (100000, "xl"), (None, "xxl"))
#: Fixed values of the two cost models: parameters, layers, width.
JUDGE_PARAMS, JUDGE_LAYERS, JUDGE_WIDTH = 3.633e9, 36, 2560
NO_EVIDENCE = -1e9


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def bound(x: Column, f) -> Column:
    """f of x, with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def chunks(tokens: Column, size: int) -> Column:
    """Consecutive runs of `size` tokens, joined by spaces."""
    def runs(ts):
        n = F.ceil(F.size(ts) / F.lit(size)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(ts, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def n_words(text: Column) -> Column:
    return F.size(words(text))


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def length_bucket(n: Column) -> Column:
    out = F.when(n < BUCKETS[0][0], BUCKETS[0][1])
    for top, name in BUCKETS[1:-1]:
        out = out.when(n < top, name)
    return out.otherwise(BUCKETS[-1][1])


def call_flops(tokens: Column, params: float = JUDGE_PARAMS, layers: int = JUDGE_LAYERS, width: int = JUDGE_WIDTH) -> Column:
    """Floating-point operations of one judge call, attention counted twice."""
    t = tokens.cast("double")
    return F.lit(2.0 * params) * t + F.lit(2.0 * layers * width) * t * t


def forward_tflops(tokens: Column, params: float = 9e9, layers: int = 36, width: int = 4096) -> Column:
    """Tera floating-point operations of one forward pass, attention counted four times."""
    t = tokens.cast("double")
    return (F.lit(2.0 * params) * t + F.lit(4.0 * layers * width) * t * t) / F.lit(1e12)


def log_odds(top: Column, yes: str, no: str) -> Column:
    """Yes against no from a map of the likeliest answers; a missing side takes the smallest logprob less 2, both missing that less 50."""
    y, n = F.try_element_at(top, F.lit(yes)), F.try_element_at(top, F.lit(no))
    floor = F.array_min(F.map_values(top)) - 2.0
    return (F.when(F.coalesce(F.size(F.map_keys(top)), F.lit(0)) == 0, F.lit(NO_EVIDENCE)).when(y.isNotNull() & n.isNotNull(), y - n)
            .when(y.isNotNull(), y - floor).when(n.isNotNull(), floor - n).otherwise(floor - 50.0))


def softmax_first(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(b - a))


def best_variant(top: Column, variants: list[str]) -> Column:
    """The variant with the largest logprob, the first of equals."""
    have = F.filter(F.array(*[F.struct(F.try_element_at(top, F.lit(v)).alias("p"), F.lit(-i).alias("o"), F.lit(v).alias("v")) for i, v in enumerate(variants)]), lambda x: x["p"].isNotNull())
    return F.array_max(have)["v"]


def prompt(query: Column, text: Column) -> Column:
    return F.concat(F.lit("Query: "), query, F.lit("\nDocument: "), text, F.lit("\nIs this document relevant to the query? Answer Yes or No:"))


#: Fixed values of the option judge: its instruction, question and lead-in.
SYSTEM = "You are an expert reasoning AI."
OPTIONS = ("\nOptions:\nA) Yes, this document is highly relevant to the query.\nB) No, this document is completely irrelevant to the query.\n\n"
           "Question: Is this document relevant to the query? You MUST choose A or B.")
LEAD_IN = "\nTo answer, I will select the single best option letter. The correct option is ("


def option_prompt(query: Column, text: Column, template: str = SYSTEM + "\n\nPLACEHOLDER\n") -> Column:
    """The option judge's prompt around labelled chunks or a whole text; template: a chat template's text, the user's part marked PLACEHOLDER."""
    before, _, after = (template + LEAD_IN).partition("PLACEHOLDER")
    return F.concat(F.lit(before + "Query: "), query, F.lit("\n\nDocument:\n"), text, F.lit(OPTIONS + after))


def coordinates(text: Column) -> Column:
    """Distinct (r, c) string pairs in order of appearance: those written Cell (r, c), or else the bare ones; none for null, empty, NAN or N/A."""
    def pairs(pattern):
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("r"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("c"))

    cell, bare = pairs(r"(?i)cell\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)"), pairs(r"\(\s*(\d+)\s*,\s*(\d+)\s*\)")
    join = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.concat_ws(",", x["r"], x["c"])))
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | F.upper(F.trim(text)).isin("", "NAN", "N/A"), empty).when(F.size(cell) > 0, join(cell)).otherwise(join(bare))


def percent_cents(hits: Column, of: Column) -> Column:
    """100 hits / of in hundredths, rounded half up, as an integer."""
    return F.floor((F.lit(20000) * hits + of) / (F.lit(2) * of)).cast("long")
