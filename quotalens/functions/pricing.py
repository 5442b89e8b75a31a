"""Token prices: model lookup, effective dates, costs and credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Provider prefixes tried, in this order, before any key that ends in the model.
PREFIXES = ("openai", "anthropic")
#: Input tokens of one request (cached and cache creation included) above which context is long.
LONG_CONTEXT, LONG_INPUT, LONG_OUTPUT = 272_000, 2.0, 1.5
#: Model prefixes whose long context costs more, and the first of them, which is billed fast and long at once.
LONG_MODELS, BOTH_MODEL = ("gpt-6-astra", "gpt-5.6"), "gpt-6-astra"
#: Cost of fast mode by model prefix, the first that fits (None: no fast tier).
FAST = (
    ("gpt-6-astra", 2.0),
    ("gpt-5.6", 2.0),
    ("gpt-5.5", 2.5),
    ("gpt-5.4-mini", None),
    ("gpt-5.4", 2.0),
    ("claude-opus-5", 2.0),
    ("claude-opus-4-8", 2.0),
    ("claude-opus-4-7", 6.0),
    ("claude-opus-4-6", 6.0),
)
#: Credits a million tokens (input and cache creation, cached input, output) by model, and what fast mode multiplies.
CREDITS = {
    "gpt-6-astra": (250.0, 25.0, 1250.0),
    "gpt-5.6-sol": (100.0, 10.0, 500.0),
    "gpt-5.6-terra": (50.0, 5.0, 300.0),
    "gpt-5.6-luna": (5.0, 0.5, 30.0),
    "gpt-5.5": (125.0, 12.5, 750.0),
    "gpt-5.4": (62.5, 6.25, 375.0),
}
CREDITS_FAST, CREDITS_FAST_OF = 2.5, {"gpt-5.4": 2.0}
MAX_PRICES = 10_000


def model_name(model: Column) -> Column:
    """A key as it is looked up: without outer spaces, lower case."""
    return F.lower(F.trim(model))


def price_names(prices: DataFrame) -> DataFrame:
    """(name, price_model): every name that finds a price: the key itself, else prefix/name, else the smallest key that ends in /name.

    Case and outer spaces of either side do not matter. The names are the tails of the keys, so the table is as small as the prices are,
    and events meet it by one equality. A blank name finds none.
    """
    key = prices.select(F.col("model").alias("price_model"), model_name(F.col("model")).alias("_key")).distinct().withColumn("_parts", F.split("_key", "/"))
    tails = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda k: F.array_join(F.slice("_parts", k, F.size("_parts")), "/"))
    named = key.withColumn("name", F.explode(tails)).where("name != ''")
    rank = F.when(F.col("_key") == F.col("name"), 0)
    for k, p in enumerate(PREFIXES):
        rank = rank.when(F.col("_key") == F.concat(F.lit(p + "/"), "name"), k + 1)
    return named.groupBy("name").agg(F.min_by("price_model", F.struct(rank.otherwise(len(PREFIXES) + 1), "_key", "price_model")).alias("price_model"))


def price_asof(events: DataFrame, prices: DataFrame) -> DataFrame:
    """The price period with the greatest start at or before the event; before the first period, the first.

    Periods become half-open intervals [from, until) with the first reaching back to the beginning, so that each event
    meets one row of its model: an equality join on the model's name with a range filter. Events are read once. The names with their
    periods are broadcast only while they have at most MAX_PRICES rows; counting reads prices alone.
    """
    w = Window.partitionBy("price_model").orderBy(F.col("from_us").asc_nulls_first())
    periods = prices.withColumnRenamed("model", "price_model").withColumn("_until", F.lead("from_us").over(w)).withColumn("_nth", F.row_number().over(w))
    periods = periods.withColumn("_since", F.when(F.col("_nth") == 1, F.lit(None)).otherwise(F.col("from_us")))
    keyed = price_names(prices).join(periods, "price_model")
    if keyed.limit(MAX_PRICES + 1).count() <= MAX_PRICES:
        keyed = F.broadcast(keyed)
    e, p = events.alias("e"), keyed.alias("p")
    at = (F.col("p._since").isNull() | (F.col("e.us") >= F.col("p._since"))) & (F.col("p._until").isNull() | (F.col("e.us") < F.col("p._until")))
    costs = [F.col(f"p.{c}") for c in ("price_model", "from_us", "input_cost", "output_cost", "cache_read_cost", "cache_write_cost", "cache_write_1h_cost")]
    return e.join(p, (model_name(F.col("e.model")) == F.col("p.name")) & at, "left").select("e.*", *costs)


def _starts(model: Column, prefixes: tuple) -> Column:
    return F.coalesce(F.greatest(*[model.startswith(p) for p in prefixes]), F.lit(False)) if len(prefixes) > 1 else F.coalesce(model.startswith(prefixes[0]), F.lit(False))


def fast_multiplier(model: Column) -> Column:
    """what fast mode multiplies the cost of a model by; null without a fast tier."""
    made, name = None, model_name(model)
    for prefix, by in FAST:
        made = F.when(name.startswith(prefix), F.lit(by).cast("double")) if made is None else made.when(name.startswith(prefix), F.lit(by).cast("double"))
    return made


def token_cost(priced: DataFrame, reasoning_as_output: bool = False) -> DataFrame:
    """dollars, rounded to 12 places; no price gives null.

    One-hour cache creation (cache_creation_1h_input_tokens, a part of cache_creation_input_tokens) has its own price, or
    the common one where that is missing or zero. Over LONG_CONTEXT tokens of input of all kinds, LONG_MODELS cost
    LONG_INPUT and LONG_OUTPUT times as much. Fast mode multiplies by ``fast_multiplier``, on long requests for BOTH_MODEL
    alone. Null token counts count 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in priced.columns else F.lit(0)
    name = model_name(F.col("model"))
    hour, created = n("cache_creation_1h_input_tokens"), n("cache_creation_input_tokens")
    hour_cost = F.when(F.col("cache_write_1h_cost") > 0, F.col("cache_write_1h_cost")).otherwise(F.col("cache_write_cost"))
    inputs = n("input_tokens") * F.col("input_cost") + n("cached_input_tokens") * F.col("cache_read_cost") + F.greatest(created - hour, F.lit(0)) * F.col("cache_write_cost") + hour * hour_cost
    outputs = n("output_tokens") * F.col("output_cost")
    if reasoning_as_output:
        outputs = outputs + n("reasoning_output_tokens") * F.col("output_cost")
    long = _starts(name, LONG_MODELS) & (n("input_tokens") + n("cached_input_tokens") + created > LONG_CONTEXT)
    fast = F.coalesce(F.col("speed_mode") == "fast", F.lit(False)) & (_starts(name, (BOTH_MODEL,)) | ~long)
    cost = inputs * F.when(long, LONG_INPUT).otherwise(1.0) + outputs * F.when(long, LONG_OUTPUT).otherwise(1.0)
    cost = cost * F.when(fast, F.coalesce(fast_multiplier(F.col("model")), F.lit(1.0))).otherwise(1.0)
    return priced.withColumn("cost", F.round(cost / 1e6, 12))


def credits(events: DataFrame) -> DataFrame:
    """credits by model and speed; null for a model without a rate and for an unknown or blank speed."""
    made = None
    for model, (i, c, o) in CREDITS.items():
        one = ((F.col("input_tokens") + F.col("cache_creation_input_tokens")) * i + F.col("cached_input_tokens") * c + F.col("output_tokens") * o) / 1e6
        one = one * F.when(F.col("speed_mode") == "fast", CREDITS_FAST_OF.get(model, CREDITS_FAST)).otherwise(1.0)
        made = F.when(F.col("model") == model, one) if made is None else made.when(F.col("model") == model, one)
    known = ~F.coalesce(F.col("speed_mode"), F.lit("")).isin("", "unknown")
    return events.withColumn("credits", F.round(F.when(known, made), 9))


CREDITS_SQL = """round(CASE WHEN coalesce(speed_mode, '') IN ('', 'unknown') THEN NULL ELSE ((input_tokens + cache_creation_input_tokens) * r.i + cached_input_tokens * r.c + output_tokens * r.o) / 1e6
    * CASE WHEN speed_mode <> 'fast' THEN CAST(1 AS DOUBLE) WHEN ue.model = 'gpt-5.4' THEN 2 ELSE CAST(2.5 AS DOUBLE) END END, 9)"""
CREDIT_RATES_SQL = "(VALUES " + ", ".join(f"('{m}', CAST({i} AS DOUBLE), CAST({c} AS DOUBLE), CAST({o} AS DOUBLE))" for m, (i, c, o) in CREDITS.items()) + ") AS r(model, i, c, o)"
_FAST_SQL = """CASE WHEN m LIKE 'gpt-6-astra%' OR m LIKE 'gpt-5.6%' THEN 2 WHEN m LIKE 'gpt-5.5%' THEN CAST(2.5 AS DOUBLE) WHEN m LIKE 'gpt-5.4%' AND m NOT LIKE 'gpt-5.4-mini%' THEN 2
    WHEN m LIKE 'claude-opus-5%' OR m LIKE 'claude-opus-4-8%' THEN 2 WHEN m LIKE 'claude-opus-4-7%' OR m LIKE 'claude-opus-4-6%' THEN 6 ELSE 1 END"""


def sql(head: str, tail: str) -> str:
    """DuckDB SQL of the lookup, the as-of join and the cost."""
    return f"""{head},
    keys AS (SELECT m.model, p.model AS price_model, CASE WHEN lower(trim(p.model)) = lower(trim(m.model)) THEN 0 WHEN lower(trim(p.model)) = 'openai/' || lower(trim(m.model)) THEN 1 WHEN lower(trim(p.model)) = 'anthropic/' || lower(trim(m.model)) THEN 2 ELSE 3 END AS rank
        FROM (SELECT DISTINCT model FROM ue) m JOIN (SELECT DISTINCT model FROM prices) p ON trim(m.model) <> '' AND (lower(trim(p.model)) = lower(trim(m.model)) OR ends_with(lower(trim(p.model)), '/' || lower(trim(m.model))))),
    best AS (SELECT model, arg_min(price_model, (rank, lower(trim(price_model)), price_model)) AS price_model FROM keys GROUP BY 1),
    periods AS (SELECT *, lead(from_us) OVER w AS until_us, row_number() OVER w AS nth FROM prices WINDOW w AS (PARTITION BY model ORDER BY from_us NULLS FIRST)),
    priced AS (SELECT ue.*, lower(trim(ue.model)) AS m, b.price_model, p.from_us, p.input_cost, p.output_cost, p.cache_read_cost, p.cache_write_cost, p.cache_write_1h_cost FROM ue LEFT JOIN best b ON ue.model = b.model
        LEFT JOIN periods p ON p.model = b.price_model AND (p.nth = 1 OR us >= p.from_us) AND (p.until_us IS NULL OR us < p.until_us)),
    parts AS (SELECT *, input_tokens * input_cost + cached_input_tokens * cache_read_cost + greatest(cache_creation_input_tokens - cache_creation_1h_input_tokens, 0) * cache_write_cost
            + cache_creation_1h_input_tokens * CASE WHEN cache_write_1h_cost > 0 THEN cache_write_1h_cost ELSE cache_write_cost END AS ins, output_tokens * output_cost AS outs,
        (m LIKE 'gpt-6-astra%' OR m LIKE 'gpt-5.6%') AND input_tokens + cached_input_tokens + cache_creation_input_tokens > 272000 AS is_long FROM priced),
    costed AS (SELECT event_id, price_model, round((ins * CASE WHEN is_long THEN 2 ELSE 1 END + outs * CASE WHEN is_long THEN CAST(1.5 AS DOUBLE) ELSE 1 END)
        * CASE WHEN speed_mode = 'fast' AND (m LIKE 'gpt-6-astra%' OR NOT is_long) THEN {_FAST_SQL} ELSE 1 END / 1e6, 12) AS cost FROM parts)
    {tail}"""
