"""Operator 2: sampling documents so that the token mix meets target shares.

Token weights of the cells (source, language, topic) are raked to the target marginals by
iterative proportional fitting: each step scales the cells of every value of one dimension to its
target, never above the tokens the cell has; goals that the tokens can't give are handed on. A document's probability is the raked weight of its
cell over the cell's tokens; whether it is drawn follows from a hash, so a run can be repeated.
Built-in DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import free_name, scratch

MISSING = "(none)"
TOLERANCE = 5e-3   # share of its goal that a marginal may be off
PATIENCE = 4       # rounds in one plan; they must bring the worst marginal nearer, below SLOW of what it was off
SLOW = 0.85
LEAP = 4.0         # most that a factor grows in one step

#: Topic by the look of a text; the first rule that holds counts.
TOPIC_RULES = (("licence", "contains(text, 'License')"), ("table", "contains(text, ' | ')"),
               ("marked", "contains(text, '***') OR contains(text, '###')"),
               ("contact", "contains(text, '@')"), ("code", "contains(text, ' = ')"))


def token_count(text: Column) -> Column:
    """Runs without white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text_col: str) -> Column:
    rule = None
    for name, test in TOPIC_RULES:
        test = F.expr(test.replace("(text", f"(`{text_col}`"))
        rule = F.when(test, name) if rule is None else rule.when(test, name)
    return rule.otherwise("prose")


def rake(cells: DataFrame, dims: list[str], budget: float, targets: dict[str, dict[str, float]] | None = None,
         temperature: float = 0.7, tolerance: float = TOLERANCE, max_rounds: int = 120) -> tuple[DataFrame, DataFrame]:
    """``cells`` (dims, tokens) with ``weight``, and the marginals they were raked to.

    Targets are shares by value; values without a target get none of the budget. A dimension
    without targets is tempered: share proportional to tokens to the power ``temperature``. No
    value is asked for more tokens than it has: what a short one can't give is asked of the others
    of its dimension, in proportion to their shares. Where a dimension's wanted values have fewer
    tokens than ``budget`` names, the whole draw is that much smaller.

    The weight of a cell is its tokens times one factor for each of its values, its tokens at most.
    A round fits the factors of one dimension after the other; what a value lacks is put on its
    cells that are not full. Only the cells are shuffled, and written after ``PATIENCE`` rounds. It
    ends when every marginal is within ``tolerance`` of its goal, or after ``max_rounds``. Marginals
    that can each be met may still exclude each other: when that many rounds bring the worst one little
    nearer, every goal moves half of the way to what the other dimensions leave to it, and raking goes on.

    The second table has ``dimension, value, tokens, asked, goal, reached, deviation``: the tokens
    asked for, the goal at the end (other than ``asked`` only where the goals excluded each other),
    the raked tokens and how far these are from ``asked``, as a share of it (0 where none was asked).
    """
    cells = scratch(cells, "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    masses = {dim: scratch(_wanted(cells, dim, (targets or {}).get(dim), temperature), "masses") for dim in dims}
    draw = min([budget * total, *(m.filter("wanted > 0").agg(F.sum("mass")).first()[0] or 0 for m in masses.values())])
    state = cells.withColumn("_raw", F.col("tokens") * F.lit(float(budget)))
    for k, (dim, mass) in enumerate(masses.items()):
        asked = mass.select(F.col("value").alias(dim), _attainable(mass, draw).alias(f"_asked{k}"))
        state = state.join(asked, dim).withColumns({f"_goal{k}": F.col(f"_asked{k}"), f"_got{k}": F.lit(0.0), f"_off{k}": F.lit(0.0)})
    state, before = scratch(state, "raked"), float("inf")
    for _ in range(-(-max_rounds // PATIENCE) if draw else 0):
        for k, dim in [*enumerate(dims)] * PATIENCE:
            state = _fitted(state, k, dim)
        state = scratch(state, "raked")
        # How far each dimension was off before its own last step shows how settled all are.
        worst = state.agg(*[F.max(f"_off{k}") for k in range(len(dims))]).first()
        worst = max(x or 0.0 for x in worst)
        if worst <= tolerance:
            break
        if worst > SLOW * before:
            state = state.withColumns({f"_goal{k}": (F.col(f"_goal{k}") + F.col(f"_got{k}")) / 2 for k in range(len(dims))})
        before = worst if worst <= SLOW * before else float("inf")
    weight = F.least(F.col("tokens").cast("double"), F.col("_raw")).alias("weight")
    marginals = reduce(DataFrame.unionAll, [state.groupBy(F.col(dim).alias("value")).agg(
        F.sum("tokens").alias("tokens"), F.first(f"_asked{k}").alias("asked"), F.first(f"_goal{k}").alias("goal"),
        F.sum(weight).alias("reached")).select(
        F.lit(dim).alias("dimension"), "*",
        F.when(F.col("asked") > 0, F.abs(F.col("reached") - F.col("asked")) / F.col("asked")).otherwise(0.0).alias("deviation"))
        for k, dim in enumerate(dims)])
    return state.select(*dims, "tokens", weight), marginals


def _wanted(cells: DataFrame, dim: str, shares: dict[str, float] | None, temperature: float) -> DataFrame:
    """``value, mass, wanted``: tokens and wanted share (of any sum) of each value of a dimension."""
    mass = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("mass"))
    if shares is None:
        wanted = F.pow(F.col("mass").cast("double"), F.lit(temperature))
    else:
        pairs = [x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))]
        wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col("value")), F.lit(0.0)) if pairs else F.lit(0.0)
    return mass.withColumn("wanted", F.when(F.col("mass") > 0, wanted).otherwise(0.0))


def _attainable(mass: DataFrame, draw: float) -> Column:
    """The goals of a dimension: in proportion to ``wanted``, no more than the tokens, ``draw`` together.

    The scale follows from the values that are short of tokens under the scale before; that set
    only grows, so it settles after as many steps as it grows, at most.
    """
    scale = 0.0
    while True:
        short = (F.col("wanted") > 0) & (F.lit(scale) * F.col("wanted") >= F.col("mass"))
        full, rest = mass.agg(F.sum(F.when(short, F.col("mass"))), F.sum(F.when(~short, F.col("wanted")))).first()
        if not rest:
            return F.when(F.col("wanted") > 0, F.col("mass").cast("double")).otherwise(0.0)
        step = max(0.0, draw - (full or 0)) / rest
        if step <= scale * (1 + 1e-12):
            return F.least(F.col("mass").cast("double"), F.lit(scale) * F.col("wanted"))
        scale = step


def _fitted(state: DataFrame, k: int, dim: str) -> DataFrame:
    """The cells after a step that fits one dimension to its goals; ``_got`` and ``_off``: what each value had before."""
    full, raw, goal, got = F.col("tokens").cast("double"), F.col("_raw"), F.col(f"_goal{k}"), F.col(f"_got{k}")
    value = Window.partitionBy(dim)
    state = state.withColumns({f"_got{k}": F.sum(F.least(full, raw)).over(value),
                               "_open": F.sum(F.when(raw < full, raw).otherwise(0.0)).over(value)})
    more = F.least(F.lit(LEAP), 1 + (goal - got) / F.col("_open"))
    step = (F.when(got <= 0, 0.0).when(goal <= got, goal / got).when(F.col("_open") > 0, more).otherwise(1.0))
    off = F.when(goal > 0, F.abs(goal - got) / goal).otherwise(0.0)
    return state.withColumns({"_raw": raw * step, f"_off{k}": off}).drop("_open")


def mix_sources(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                lang_col: str = "lang", topic: Column | None = None, budget: float = 0.5,
                targets: dict[str, dict[str, float]] | None = None, temperature: float = 0.5,
                seed: int = 2) -> DataFrame:
    """The rows of ``df`` with ``mix_topic, mix_tokens, mix_probability, mix_sampled``.

    ``budget`` is the share of all tokens to draw. NULL sources, languages and topics form a
    value of their own. Texts without a token (NULL, empty, blank) have probability 0. Whether a
    row is drawn hangs on its id, its text and ``seed`` alone, so repeated rows fare alike.
    Columns of ``df`` with those four names, ``mix_source`` or ``mix_lang`` are left out or replaced.
    """
    own = ["mix_source", "mix_lang", "mix_topic"]
    tagged, (weighted, _) = _raked(df, text_col, source_col, lang_col, topic, budget, targets, temperature)
    rate = free_name(df, "mix_rate")
    rates = weighted.select(*own, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias(rate))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    kept = [c for c in tagged.columns if c not in (*own, "mix_tokens")]
    probability = F.when(F.col("mix_tokens") > 0, F.col(rate)).otherwise(0.0)
    return (tagged.join(rates, own).withColumn("mix_probability", probability)
            .withColumn("mix_sampled", draw < F.col("mix_probability"))
            .select(*kept, "mix_topic", "mix_tokens", "mix_probability", "mix_sampled"))


def mix_marginals(df: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  topic: Column | None = None, budget: float = 0.5,
                  targets: dict[str, dict[str, float]] | None = None, temperature: float = 0.5) -> DataFrame:
    """What ``mix_sources`` with these arguments asks of each source, language and topic and what it reaches.

    Columns as in the second table of ``rake``. An empty table gives no row.
    """
    marginals = _raked(df, text_col, source_col, lang_col, topic, budget, targets, temperature)[1][1]
    return marginals.withColumn("dimension", F.substring("dimension", len("mix_") + 1, 99))


def _raked(df, text_col, source_col, lang_col, topic, budget, targets, temperature):
    """The rows with their cell and tokens; the raked cells and marginals."""
    own = ["mix_source", "mix_lang", "mix_topic"]
    tagged = df.drop("mix_topic", "mix_tokens", "mix_probability", "mix_sampled", *own[:2]).withColumns({
        "mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit(MISSING)),
        "mix_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(MISSING)),
        "mix_topic": F.coalesce(topic if topic is not None else topic_of(text_col), F.lit(MISSING)),
        "mix_tokens": token_count(F.col(text_col))})
    cells = tagged.groupBy(*own).agg(F.sum("mix_tokens").alias("tokens"))
    named = {f"mix_{k}": v for k, v in (targets or {}).items()}
    return tagged, rake(cells, own, budget, named, temperature)
