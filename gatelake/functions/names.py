"""Artifact names and paths: parsing, canonical keys, clean names and lineage paths, as column expressions.

Tier 0 holds synthesized circuits, tier 1 the outputs of one optimizer, tier 2 those of a second one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The optimizers in file names, and the grammar of stems.
ALGORITHMS = ("Orchestrate", "Deepsyn", "Syn4", "C2RS")
_ANY = "C2RS|Deepsyn|Orchestrate|Syn4"
TIER0 = r"^(.+?)_syn([0-9X]+)_step(\d+)$"
TIER0_BARE = r"^syn([0-9X]+)_step(\d+)$"
TIER1 = rf"^(.+?)_({_ANY})_tier1_(?:(.+?)_)?syn([0-9X]+)_step(\d+)$"
TIER2 = rf"^(.+?)_({_ANY})_({_ANY})_tier2_(?:(.+?)_)?syn([0-9X]+)_step(\d+)$"
LOOSE0 = r"^(.+?)_(syn[0-9X]+_step\d+)$"
LOOSE1 = rf"^(.+?)_({_ANY})_tier1_(.+)$"
LOOSE2 = rf"^(.+?)_({_ANY})_({_ANY})_tier2_(.+)$"
RECIPE = r"^(syn[0-9X]+)_step\d+$"

_part = F.regexp_extract


def basename(path: Column) -> Column:
    return _part(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def replace_basename(path: Column, name: Column) -> Column:
    return F.concat(_part(path, r"^(.*/)?[^/]*$", 1), name)


def artifact(name: Column, design_hint: Column | None = None, tier_hint: Column | None = None) -> Column:
    """struct(tier, design, src, dst, recipe, step, state) of a file name; state is clean, messy or unrecognized.

    Tier 2 is tried before tier 1 and both before tier 0, whose pattern fits their names too. A tier 0 file under a
    known design takes its design from there. The name is rewritten once to fields between bars, then cut."""
    s = stem(name)
    hint = F.lit("") if design_hint is None else F.coalesce(design_hint, F.lit(""))
    at0 = F.lit(False) if tier_hint is None else F.coalesce(tier_hint == 0, F.lit(False)) & (hint != "")
    fields = (
        F.when(s.contains("_tier2_") & s.rlike(TIER2), F.regexp_replace(s, TIER2, "2|$1|$2|$3|$5|$6|$4"))
        .when(s.contains("_tier1_") & s.rlike(TIER1), F.regexp_replace(s, TIER1, "1|$1||$2|$4|$5|$3"))
        .when(at0 & s.rlike(TIER0_BARE), F.concat(F.lit("0|"), hint, F.regexp_replace(s, TIER0_BARE, "|||$1|$2|bare")))
        .when(at0 & s.rlike(TIER0), F.concat(F.lit("0|"), hint, F.regexp_replace(s, TIER0, "|||$2|$3|"), F.when(_part(s, TIER0, 1) == hint, "").otherwise("other")))
        .when(s.rlike(TIER0), F.regexp_replace(s, TIER0, "0|$1|||$2|$3|"))
    )

    def cut(p: Column) -> Column:
        text = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
        tier = F.coalesce(F.get(p, F.lit(0)).try_cast("int"), F.lit(-1))
        state = F.when(tier < 0, "unrecognized").when(F.get(p, F.lit(6)) != "", "messy").otherwise("clean")
        return F.struct(tier.alias("tier"), text(1).alias("design"), text(2).alias("src"), text(3).alias("dst"), text(4).alias("recipe"), text(5).alias("step"), state.alias("state"))

    # a lambda over one element, so that the fields are cut once and not for every use
    return F.get(F.transform(F.array(F.split(F.coalesce(fields, F.lit("")), r"\|")), cut), F.lit(0))


def stem_fields(s: Column) -> Column:
    """struct(tier, design, src, dst, tail) of a stem by the loose grammars, the most specific one that fits; tier -1 if none."""
    none = F.lit(None).cast("string")

    def of(tier: int, design: Column, src: Column, dst: Column, tail: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), design.alias("design"), src.alias("src"), dst.alias("dst"), tail.alias("tail"))

    two = of(2, *[_part(s, LOOSE2, i) for i in (1, 2, 3, 4)])
    one = of(1, _part(s, LOOSE1, 1), none, _part(s, LOOSE1, 2), _part(s, LOOSE1, 3))
    return F.when(s.rlike(LOOSE2), two).when(s.rlike(LOOSE1), one).when(s.rlike(LOOSE0), of(0, _part(s, LOOSE0, 1), none, none, _part(s, LOOSE0, 2))).otherwise(of(-1, none, none, none, none))


def _tier_number(part: Column) -> Column:
    return F.when(part.startswith("tier"), F.replace(part, F.lit("tier"), F.lit("")).try_cast("int"))


def artifact_of_csv_path(path: Column) -> Column:
    """Parses a metadata path; ``base_aigs/<design>/tier<N>/`` gives the hints."""
    design = F.nullif(_part(path, r"(?:^|/)base_aigs/([^/]+)", 1), F.lit(""))
    tier = F.nullif(_part(path, r"(?:^|/)base_aigs/[^/]+/(tier[^/]*)", 1), F.lit(""))
    return artifact(basename(path), design, _tier_number(tier))


def artifact_of_graph_path(path: Column) -> Column:
    """Parses a graph path; ``graphs/tier<N>/`` gives the hints, the design one level deeper for tier 1."""
    tier = _tier_number(F.nullif(_part(path, r"(?:^|/)graphs/(tier[^/]*)", 1), F.lit("")))
    shallow = F.nullif(_part(path, r"(?:^|/)graphs/[^/]+/([^/]+)", 1), F.lit(""))
    deep = F.nullif(_part(path, r"(?:^|/)graphs/[^/]+/[^/]+/([^/]+)", 1), F.lit(""))
    return artifact(basename(path), F.when(tier == 1, deep).otherwise(shallow), tier)


def canonical_id(key: Column) -> Column:
    """T0_.., T1_.. or T2_.. of an artifact key."""
    tail = F.concat(F.lit("_syn"), key.recipe, F.lit("_step"), key.step)
    return F.when(key.tier >= 0, F.concat(F.lit("T"), key.tier.cast("string"), F.lit("_"), F.concat_ws("_", key.design, key.src, key.dst), tail))


def clean_basename(key: Column, suffix: str) -> Column:
    """The name that an artifact should have."""
    tail = F.concat(F.lit("_syn"), key.recipe, F.lit("_step"), key.step, F.lit(suffix))
    middle = F.when(key.tier == 0, F.lit("")).otherwise(F.concat(F.lit("_tier"), key.tier.cast("string")))
    return F.when(key.tier >= 0, F.concat(F.concat_ws("_", key.design, key.src, key.dst), middle, tail)).otherwise("")


def expected_graph_path(root: str, key: Column) -> Column:
    folder = F.concat_ws("/", F.lit(root), F.concat(F.lit("tier"), key.tier.cast("string")), F.when(key.tier == 1, key.dst), key.design)
    return F.when(key.tier >= 0, F.concat_ws("/", folder, clean_basename(key, ".pt"))).otherwise("")


def input_graph_path(root: str, file_path: Column, tier: Column, design: Column) -> Column:
    """The graph that a model reads for a row: its own for tier 0, that of the tier below for tiers 1 and 2."""
    s, own = stem(file_path), F.trim(F.coalesce(design, F.lit("")))
    fail = lambda what: F.raise_error(F.concat(F.lit(what), s)).cast("string")
    base = F.when(own != "", own).when(s.rlike(LOOSE0), _part(s, LOOSE0, 1)).otherwise(fail("no design for "))
    at0 = F.concat_ws("/", F.lit(f"{root}/graphs/tier0"), base, F.concat(s, F.lit(".pt")))
    d1, d2, src = _part(s, LOOSE1, 1), _part(s, LOOSE2, 1), _part(s, LOOSE2, 2)
    at1 = F.when(s.rlike(LOOSE1), F.concat_ws("/", F.lit(f"{root}/graphs/tier0"), d1, F.concat(d1, F.lit("_"), _part(s, LOOSE1, 3), F.lit(".pt")))).otherwise(fail("not a tier 1 name: "))
    at2 = F.when(s.rlike(LOOSE2), F.concat_ws("/", F.lit(f"{root}/graphs/tier1"), src, d2, F.concat(d2, F.lit("_"), src, F.lit("_tier1_"), _part(s, LOOSE2, 4), F.lit(".pt")))).otherwise(fail("not a tier 2 name: "))
    deeper = F.when(own == "", fail("no design for ")).otherwise(F.concat_ws("/", F.concat(F.lit(f"{root}/graphs/tier"), tier.cast("string")), own, F.concat(s, F.lit(".pt"))))
    return F.when(F.trim(file_path) == "", fail("no file_path")).when(tier == 0, at0).when(tier == 1, at1).when(tier == 2, at2).otherwise(deeper)


def recipe_of_stem(s: Column) -> Column:
    """synN of a stem, from the most specific grammar that fits; null if it has none."""
    suffix = F.when(s.rlike(LOOSE2), _part(s, LOOSE2, 4)).when(s.rlike(LOOSE1), _part(s, LOOSE1, 3)).when(s.rlike(LOOSE0), _part(s, LOOSE0, 2))
    return F.nullif(_part(suffix, RECIPE, 1), F.lit(""))


def design_of_path(path: Column) -> Column:
    """The folder one below ``designs`` or ``tier0``, or two below ``tier1`` or ``tier2``; else the path itself."""
    found = [F.nullif(_part(path, rf"(?:^|/){marker}/([^/]+)" if depth == 1 else rf"(?:^|/){marker}/[^/]*/([^/]+)", 1), F.lit("")) for marker, depth in (("designs", 1), ("tier0", 1), ("tier1", 2), ("tier2", 2))]
    return F.coalesce(*found, path)


def recipe_of_path(path: Column) -> Column:
    """The recipe of a graph, or its design where the name has none."""
    return F.coalesce(recipe_of_stem(stem(path)), design_of_path(path))


def known_design(path: Column) -> Column:
    at0, at1 = _part(path, r"/tier0/([^/]+)/", 1), _part(path, r"/tier1/[^/]+/([^/]+)/", 1)
    return F.coalesce(F.nullif(at0, F.lit("")), F.nullif(at1, F.lit("")), F.lit("unknown design"))


def source_script(path: Column) -> Column:
    return F.coalesce(F.nullif(_part(path, r"/tier1/([^/]+)/", 1), F.lit("")), F.lit("tier0 base"))


def normal_path(path: Column, old: str = "/gpfs/scratch1/shared", new: str = "/scratch-shared") -> Column:
    return F.replace(path, F.lit(old), F.lit(new))


def recipe_stem(recipe: Column, step: Column) -> Column:
    plain = F.concat(F.lit("syn"), recipe.cast("string"), F.lit("_step"), step.cast("string"))
    return F.when((recipe == 0) & (step == 0), "synX_step0").otherwise(plain)


def tier2_source(stem_or_name: Column, design: Column) -> Column:
    """The first optimizer of a tier 2 name, null if none follows the design."""
    rest = F.when(stem_or_name.startswith(F.concat(design, F.lit("_"))), F.substr(stem_or_name, F.length(design) + 2))
    return F.nullif(_part(F.coalesce(rest, F.lit("")), r"^(Orchestrate|Deepsyn|Syn4|C2RS)_", 1), F.lit(""))


def tier0_path_of_log(log: Column, design: Column, algorithm: Column) -> Column:
    """The tier 0 circuit that a tier 1 log optimized; null if the name is not of that design and optimizer."""
    prefix = F.concat(design, F.lit("_"), algorithm, F.lit("_tier1_"))
    body = F.substr(log, F.length(prefix) + 1)
    path = F.concat(F.lit("base_aigs/"), design, F.lit("/tier0/"), F.regexp_replace(body, r"\.log$", ".aig"))
    return F.when(log.startswith(prefix) & log.endswith(".log"), path)


def recipe_number(recipe: Column) -> Column:
    """X, the unsynthesized original, is recipe 0."""
    return F.when(recipe == "X", 0).otherwise(recipe.try_cast("int"))
