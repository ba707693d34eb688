"""Scalar rules of the metadata and of model runs, as column expressions."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the dynamic number of partitions, and the labels of reductions and splits.
TARGET_NODES, MIN_K, MAX_K = 10_000, 2, 32
REDUCTIONS = ("sparsification", "partition", "summarization")
SPLITS = ("design", "recipe", "random")
ATTENTION = ("transformer_conv", "graphgps")


def clean(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def to_int(value: Column, default: int = 0) -> Column:
    """An int by way of a double, truncated; the default for an empty or bad value."""
    return F.coalesce(F.nullif(clean(value), F.lit("")).try_cast("double").cast("int"), F.lit(default))


def to_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.nullif(clean(value), F.lit("")).try_cast("double"), F.lit(default))


def to_tier(value: Column) -> Column:
    """Empty is tier 0, what is no number is -1."""
    text = clean(value)
    return F.when(text == "", 0).otherwise(F.coalesce(text.try_cast("double").cast("int"), F.lit(-1)))


def algorithm(value: Column, known: tuple[str, ...]) -> Column:
    """Null for empty or ``all``; an unknown name is an error."""
    text = clean(value)
    return F.when((text == "") | (F.lower(text) == "all"), F.lit(None).cast("string")).when(text.isin(*known), text).otherwise(F.raise_error(F.concat(F.lit("unknown algorithm "), text)).cast("string"))


def relative_reduction(before: Column, after: Column) -> Column:
    """(before - after) / before to 4 places; 0 where there was nothing before."""
    b, a = before.cast("double"), after.cast("double")
    return F.round(F.when(b > 0, (b - a) / b).otherwise(0.0), 4)


def num_nodes(pi: Column, gates: Column, po: Column) -> Column:
    """The constant, inputs, gates and outputs; null if any is unknown."""
    return F.lit(1).cast("long") + pi + gates + po


def num_edges(gates: Column, po: Column) -> Column:
    return F.lit(2).cast("long") * gates + po


def imputed_edges(edges: Column, gates: Column, po: Column) -> Column:
    """Two fanins a gate and one an output, where no count is recorded."""
    guess = F.greatest(F.lit(0), F.round(2 * F.coalesce(gates, F.lit(0)) + F.coalesce(po, F.lit(0)), 0)).cast("long")
    return F.when(F.coalesce(edges, F.lit(0)) <= 0, guess).otherwise(edges).cast("long")


def dynamic_k(n: Column, target: int = TARGET_NODES, low: int = MIN_K, high: int = MAX_K) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(n / F.lit(max(1, target))))).cast("int")


def run_label(algorithm: Column, kind: Column, method: Column, split: Column) -> Column:
    """algorithm, algorithm_kind_method or algorithm_none_split; a reduction on another split has no label."""
    reduced = F.when(split != "design", F.raise_error(F.lit("a reduction has no label on this split")).cast("string")).otherwise(F.concat_ws("_", algorithm, kind, method))
    return F.when(kind != "none", reduced).when(split != "design", F.concat_ws("_", algorithm, F.lit("none"), split)).otherwise(algorithm)


def parsed_run_label(label: Column) -> Column:
    """struct(algorithm, kind, method, split): the inverse of ``run_label``."""
    none = F.lit(None).cast("string")

    def fields(head: Column, kind: str, method: Column, split: Column) -> Column:
        return F.struct(head.alias("algorithm"), F.lit(kind).alias("kind"), method.alias("method"), split.alias("split"))

    tail = F.substring_index(label, "_none_", -1)
    out = None
    for kind in REDUCTIONS:
        mark = f"_{kind}_"
        head = F.substring_index(label, mark, 1)
        found = fields(head, kind, F.substr(label, F.length(head) + len(mark) + 1), F.lit("design"))
        out = F.when(label.contains(mark), found) if out is None else out.when(label.contains(mark), found)
    split = label.contains("_none_") & tail.isin(*SPLITS)
    return out.when(split, fields(F.substring_index(label, "_none_", 1), "none", none, tail)).otherwise(fields(label, "none", none, F.lit("design")))


def tracker_name(algorithm: Column, kind: Column, method: Column, device: Column, split: Column) -> Column:
    reduced = F.when(kind != "none", F.concat_ws("_", kind, method))
    return F.concat_ws("_", F.lit("test"), algorithm, reduced, device, F.when(split != "design", split))


def batching_label(dynamic: Column, batch_size: Column, budget: Column) -> Column:
    return F.when(dynamic, F.concat(F.lit("dynamic_nodes="), budget.cast("string"))).otherwise(F.concat(F.lit("fixed_graphs="), batch_size.cast("string")))


def splits_filename(stems: Column, samples: Column, split: Column) -> Column:
    tags = F.concat_ws("_", F.array_join(stems, "_"), F.coalesce(samples.cast("string"), F.lit("all")), F.when(split != "design", split))
    return F.concat(tags, F.lit("_splits.json"))


def stable_token(*parts: Column, length: int = 16) -> Column:
    """The head of a digest over versioned strings, the same in every run."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def cache_root(path: Column) -> Column:
    return F.when(path.contains("/tier0/"), "cache_tier0").when(path.contains("/tier1/"), "cache_tier1").otherwise("cache")


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent(got: Column, expected: Column) -> Column:
    """100 * got / expected; 0 where nothing is expected."""
    return F.coalesce(F.try_divide(F.lit(100.0) * got, F.nullif(expected.cast("double"), F.lit(0.0))), F.lit(0.0))


def saving(reduced: Column, base: Column) -> Column:
    return (F.lit(1.0) - F.try_divide(reduced, base)) * 100.0


def memory_failure(message: Column) -> Column:
    """guard, host or cuda by what a failure says, first rule first; null for other failures."""
    # What failures say, and the order in which it counts.
    text = F.lower(message)
    has = lambda *words: functools.reduce(operator.or_, [text.contains(w) for w in words])
    worker = text.contains("dataloader worker")
    return (
        F.when(has("memory guard"), "guard")
        .when(has("unable to mmap", "cannot allocate memory"), "host")
        .when(worker & has("killed by signal", "exited unexpectedly"), "host")
        .when(has("cuda out of memory", "cuda error", "illegal memory access", "acceleratorerror"), "cuda")
        .when(has("out of memory", "oom"), F.when(text.contains("cuda"), "cuda").otherwise("host"))
    )


#: Fixed values below: the factors of the cost rules, which must give the same numbers wherever they are computed.
def _multipliers(layers: Column, jk: Column, encoder: Column, heads: Column) -> tuple[Column, Column, Column]:
    knowledge = F.when(jk == "cat", layers + 1).otherwise(1)
    attention = F.when(encoder.isin(*ATTENTION), heads).otherwise(1)
    return knowledge, attention, F.when(encoder == "graphgps", 1.5).otherwise(1.0)


def memory_tokens(nodes: Column, edges: Column, hidden: Column, layers: Column, jk: Column, encoder: Column, heads: Column, expansion: Column) -> Column:
    knowledge, attention, twice = _multipliers(layers, jk, encoder, heads)
    total = nodes.cast("double") * hidden * F.greatest(F.lit(1), layers) * knowledge + edges.cast("double") * hidden * attention
    return total * expansion * twice


def trial_risk(batch: Column, nodes: Column, edges: Column, hidden: Column, layers: Column, jk: Column, encoder: Column, heads: Column, pe: Column, pe_dim: Column) -> Column:
    knowledge, attention, twice = _multipliers(layers, jk, encoder, heads)
    encoding = F.when(pe != "none", 1.0 + pe_dim / 128.0).otherwise(1.0)
    total = nodes.cast("double") * hidden * layers * knowledge * encoding + edges.cast("double") * hidden * attention
    return batch * total * twice


def output_dim(hidden: Column, layers: Column, jk: Column) -> Column:
    return F.when(jk == "cat", hidden * (layers + 1)).otherwise(hidden)


def sinusoidal(position: Column, dim: int) -> Column:
    """array of sin and cos by turns, wavelengths as a power of 10000."""
    if dim % 2:
        raise ValueError("the dimension must be even")
    waves = [math.exp(i * -(math.log(10000.0) / dim)) for i in range(0, dim, 2)]
    return F.array(*[f(position * F.lit(w)) for w in waves for f in (F.sin, F.cos)])


def clamped_level(level: Column, size: int) -> Column:
    """A level between 0 and ``size - 1``; null stays null."""
    return F.when(level.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(size - 1), level)))


def log1p_count(x: Column) -> Column:
    """log(1 + x); a negative count is an error."""
    return F.when(x < 0, F.raise_error(F.lit("a count is negative")).cast("double")).otherwise(F.log1p(x.cast("double")))
