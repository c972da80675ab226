"""Labels and normalised names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of scenario ids by corpus, the longer ones first.
CORPORA = ("bfcl-simple", "bfcl-multiple", "metatool", "toolret", "sragents")
SKILL_PREFIX = "sragents-"
WRAPPER = r"(?s)^Given a .*? task, retrieve tools that (.*)$"


def corpus_of(scenario_id: Column) -> Column:
    """The corpus that an id's prefix names, else "other"; null for null."""
    out = F.when(scenario_id.isNotNull(), F.lit("other"))
    for name in reversed(CORPORA):
        out = F.when(scenario_id.startswith(f"{name}-"), F.lit(name)).otherwise(out)
    return out


def subset_of(gold_count: Column) -> Column:
    """"multi-tool" for more than one gold item, else "single-tool"."""
    return F.when(gold_count > 1, F.lit("multi-tool")).otherwise(F.lit("single-tool"))


def bucket_of(category: Column, gold_count: Column) -> Column:
    """STRUCT<subset, mode> of a row; skill corpora are bucketed by their data set."""

    def pair(subset: Column, mode: str) -> Column:
        return F.struct(subset.alias("subset"), F.lit(mode).alias("mode"))

    return (
        F.when(category == "metatool-single", pair(F.lit("single-tool"), "tool"))
        .when(category == "metatool-multi", pair(F.lit("multi-tool"), "tool"))
        .when(category.startswith(SKILL_PREFIX), pair(F.substring(category, len(SKILL_PREFIX) + 1, 1 << 30), "skill"))
        .otherwise(pair(subset_of(gold_count), "tool"))
    )


def category_of(category: Column, coarsen: bool = True) -> Column:
    """The category, "(uncategorized)" for null; coarse: the two function-calling subsets are one."""
    known = F.coalesce(category, F.lit("(uncategorized)"))
    return F.when(known.isin("bfcl-simple", "bfcl-multiple"), F.lit("bfcl")).otherwise(known) if coarsen else known


def call_type(scenario_id: Column) -> Column:
    """"simple" or "multiple" of a function-calling scenario, null for others."""
    return F.nullif(F.regexp_extract(scenario_id, "^bfcl-(simple|multiple)-", 1), F.lit(""))


def skill_dataset(scenario_id: Column, category: Column) -> Column:
    """The data set of a skill scenario, null for others."""
    return F.when((corpus_of(scenario_id) == "sragents") & category.startswith(SKILL_PREFIX), F.substring(category, len(SKILL_PREFIX) + 1, 1 << 30))


def unwrapped(instruction: Column) -> Column:
    """The request inside an instruction "Given a ... task, retrieve tools that ...", without its final periods."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = bare(instruction)
    request = bare(F.regexp_replace(bare(F.regexp_extract(text, WRAPPER, 1)), r"\.+$", ""))
    return F.when(text.rlike(WRAPPER), request).otherwise(text)


def slug(name: Column) -> Column:
    """A file's name as part of ids: trimmed, lower-case, without the suffix "_query"."""
    return F.regexp_replace(F.lower(F.trim(name)), "_query$", "")


def safe_name(name: Column) -> Column:
    """A name of letters, digits, "_" and "-" only; others become "_", and those at the ends go."""
    return F.when(name.rlike("^[A-Za-z0-9_-]+$"), name).otherwise(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), "^[_-]+|[_-]+$", ""))


def flat_prompt(turns: Column) -> Column:
    """The user messages of ARRAY<ARRAY<STRUCT<role, content>>> by line, or all messages where no user speaks."""
    messages = F.flatten(turns)
    asked = F.filter(messages, lambda m: m["role"] == "user")
    chosen = F.when(F.size(asked) > 0, asked).otherwise(messages)
    return F.array_join(F.transform(chosen, lambda m: m["content"]), "\n")


def endpoint(model: Column) -> Column:
    """STRUCT<base_url, model> of "<base url>#<model>"; base_url is null for plain model names."""
    custom = model.rlike("^https?://.+#.+")
    return F.struct(F.when(custom, F.substring_index(model, "#", 1)).alias("base_url"), F.when(custom, F.regexp_extract(model, "#(.+)$", 1)).otherwise(model).alias("model"))


def is_prerelease(version: Column) -> Column:
    return version.contains("-")


def version_key(version: Column) -> Column:
    """A sort key that orders the numbers in a version as numbers."""
    return F.array_join(F.transform(F.split(version, "[.-]"), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), ".")


def percent_saved(control: Column, treated: Column) -> Column:
    return F.when(control == 0, F.lit(0.0)).otherwise((1 - treated / control) * 100)


def seeded_order(seed: int, *keys: Column) -> Column:
    """A sort key that is a pseudo-random order fixed by the seed, the same for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def tokens(text: Column, unicode: bool = False) -> Column:
    """Lower-case runs of letters and digits, ASCII only or of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+" if unicode else "[a-z0-9]+"), 0)
