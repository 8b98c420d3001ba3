"""Data Vault loads: hubs, links, satellites with history, point-in-time and bridge tables.

Rows are reduced on their native keys first; hash keys are computed once per remaining row, so the
wide shuffles move source keys, not 64-character digests, and a hot key is combined map-side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.hashing import digest, hash_diff, hash_key, key_text, zero_key
from sievework.functions.ordered import changes, with_neighbour

GHOST_SOURCE = "GHOST"
GHOST_DATE = "1900-01-01 00:00:00"
CURRENT = "load_end_date IS NULL"
HUB_SUFFIXES = "_(id|code|num|key)$"


@dataclass(frozen=True)
class Source:
    """Where business keys come from. load_date is a timestamp text or a column of df."""

    df: DataFrame
    keys: list[str]
    record_source: str
    load_date: str | Column

    def load_column(self) -> Column:
        if isinstance(self.load_date, Column):
            return self.load_date.cast("timestamp_ntz")
        return F.lit(self.load_date).cast("timestamp_ntz")


def _first_seen(sources: list[Source], keys: list[str]) -> DataFrame:
    """One row per native key: its first load date and the record source of that load.

    Each source is reduced by a hash aggregate before the union; the record source takes part only
    in the second aggregate, over distinct keys.
    """
    seen = None
    for s in sources:
        one = (
            s.df.groupBy(*[F.col(k).alias(n) for k, n in zip(s.keys, keys)])
            .agg(F.min(s.load_column()).alias("load_date"))
            .withColumn("record_source", F.lit(s.record_source))
        )
        seen = one if seen is None else seen.unionByName(one)
    return seen


def _missing(columns: list[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()


def _is_final(sources: list[Source], seen: DataFrame, keys: list[str]) -> bool:
    """One source, and no key column whose spelling may vary: first-seen rows are unique already."""
    return len(sources) == 1 and not any(isinstance(seen.schema[k].dataType, T.StringType) for k in keys)


def ghost(schema: T.StructType, key_columns: list[str], algo: str, spark) -> DataFrame:
    """The zero-hash row that NULL foreign keys point at."""
    fixed = {
        "load_date": F.lit(GHOST_DATE).cast("timestamp_ntz"),
        "record_source": F.lit(GHOST_SOURCE),
        **{k: zero_key(algo) for k in key_columns},
    }
    return spark.range(1).select(
        *[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def hub(
    entity: str,
    sources: list[Source],
    keys: list[str],
    existing: DataFrame | None = None,
    with_ghost: bool = True,
    algo: str = "sha256",
) -> DataFrame:
    """New hub rows: <entity>_hk, business key, load_date, record_source.

    Initial load: all keys, and the ghost record. With `existing`: only keys it lacks, to append.
    """
    hk = f"{entity}_hk"
    seen = _first_seen(sources, keys).filter(~_missing(keys))
    if _is_final(sources, seen, keys):
        first = seen
    else:
        # spellings that share a key text share a hub row; the earliest load wins
        first = (
            seen.groupBy(key_text(*[F.col(k) for k in keys]).alias("_text"))
            .agg(F.min(F.struct("load_date", "record_source", *keys)).alias("first"))
            .select("first.*")
        )
    rows = first.select(
        hash_key(*[F.col(k) for k in keys], algo=algo).alias(hk), *keys, "load_date", "record_source"
    )
    if existing is not None:
        return rows.join(existing.select(hk), hk, "left_anti")
    if with_ghost:
        rows = rows.unionByName(ghost(rows.schema, [hk], algo, rows.sparkSession))
    return rows


def link(
    name: str,
    sources: list[Source],
    hubs: dict[str, list[str]],
    existing: DataFrame | None = None,
    algo: str = "sha256",
) -> DataFrame:
    """New link rows: <name>_hk, one hash key per hub, load_date, record_source.

    hubs maps each hub entity to its columns in `sources[i].keys`, given in that order. A NULL
    foreign key points at the ghost record.
    """
    hk = f"{name}_hk"
    keys = [c for columns in hubs.values() for c in columns]
    seen = _first_seen(sources, keys)
    texts = seen.select(
        *[F.when(~_missing(c), key_text(*[F.col(x) for x in c])).alias(entity) for entity, c in hubs.items()],
        "load_date",
        "record_source",
    )
    if not _is_final(sources, seen, keys):
        texts = (
            texts.groupBy(*hubs)
            .agg(F.min(F.struct("load_date", "record_source")).alias("first"))
            .select(*hubs, "first.*")
        )
    hub_keys = [f"{entity}_hk" for entity in hubs]
    hashed = texts.select(
        *[F.coalesce(digest(F.col(e), algo), zero_key(algo)).alias(k) for e, k in zip(hubs, hub_keys)],
        "load_date",
        "record_source",
    )
    rows = hashed.select(
        hash_key(*[F.col(k) for k in hub_keys], algo=algo).alias(hk), *hub_keys, "load_date", "record_source"
    )
    return rows if existing is None else rows.join(existing.select(hk), hk, "left_anti")


def _latest(
    df: DataFrame, keys: list[str], load_date: Column, attributes: list[str], tie_break: list[str],
    parent_key: Column | None,
) -> tuple[DataFrame, list[str]]:
    """(rows, columns that tell parents apart). Rows hold the keys, load_date and the attributes as struct
    `a`: the last row of each parent and load date.

    Rows are reduced on native keys first. Text keys that share a key text are one parent, as in `hub`, so
    they are reduced again by it (or by parent_key), in column `_parent`. Rows without a key are dropped.
    """
    known = df.filter(~_missing(keys))
    rows = known.groupBy(*keys, load_date.cast("timestamp_ntz").alias("load_date")).agg(
        F.max(F.struct(F.struct(*tie_break).alias("t"), F.struct(*attributes).alias("a"))).alias("last")
    )
    if not any(isinstance(df.schema[k].dataType, T.StringType) for k in keys):
        return rows.select(*keys, "load_date", "last.a"), keys
    parent = key_text(*[F.col(k) for k in keys]) if parent_key is None else parent_key
    again = rows.groupBy(parent.alias("_parent"), "load_date").agg(F.max(F.struct("last", *keys)).alias("r"))
    return again.select("_parent", "load_date", "r.last.a", *[F.col(f"r.{k}").alias(k) for k in keys]), ["_parent"]


def _parent_hash(keys: list[str], by: list[str], algo: str, parent_key: Column | None) -> Column:
    if by == ["_parent"]:
        return digest(F.col("_parent"), algo) if parent_key is None else F.col("_parent")
    return hash_key(*[F.col(k) for k in keys], algo=algo) if parent_key is None else parent_key


def _chunk(unit: str | None) -> Column | None:
    return None if unit is None else F.date_trunc(unit, F.col("load_date"))


def satellite(
    df: DataFrame,
    parent_hk: str,
    keys: list[str],
    load_date: Column,
    attributes: list[str],
    record_source: str,
    tie_break: list[str],
    chunk: str | None = "month",
    algo: str = "sha256",
    parent_key: Column | None = None,
) -> DataFrame:
    """First load of a satellite, with full history; see `history` for `chunk`.

    Works on native keys and attributes throughout; hashes are computed for the rows that remain.
    `parent_key` replaces the hash of `keys`, for satellites on links.
    """
    latest, by = _latest(df, keys, load_date, attributes, tie_break, parent_key)
    ended = changes(latest, by, "load_date", "a", "load_end_date", _chunk(chunk))
    return ended.select(
        _parent_hash(keys, by, algo, parent_key).alias(parent_hk),
        "load_date",
        "load_end_date",
        F.lit(record_source).alias("record_source"),
        hash_diff(*[F.col(f"a.{c}") for c in attributes], algo=algo).alias("hash_diff"),
        *[F.col(f"a.{c}").alias(c) for c in attributes],
    )


def stage(
    df: DataFrame,
    parent_hk: str,
    keys: list[str],
    load_date: Column,
    attributes: list[str],
    record_source: str,
    tie_break: list[str],
    algo: str = "sha256",
    parent_key: Column | None = None,
) -> DataFrame:
    """Rows to merge into a satellite: the last of each key and load date, with both hashes."""
    latest, by = _latest(df, keys, load_date, attributes, tie_break, parent_key)
    return latest.select(
        _parent_hash(keys, by, algo, parent_key).alias(parent_hk),
        "load_date",
        F.lit(record_source).alias("record_source"),
        hash_diff(*[F.col(f"a.{c}") for c in attributes], algo=algo).alias("hash_diff"),
        *[F.col(f"a.{c}").alias(c) for c in attributes],
    )


def history(staged: DataFrame, parent_hk: str, chunk: str | None = "month") -> DataFrame:
    """Satellite rows from staged rows: unchanged repeats dropped, load_end_date set.

    Rows of a key are cut into pieces of `chunk` (a date_trunc unit), so a long history of one hot
    key is sorted by many tasks. Use None where load dates are few per key.
    """
    ended = changes(staged, [parent_hk], "load_date", "hash_diff", "load_end_date", _chunk(chunk))
    attributes = [c for c in staged.columns if c not in (parent_hk, "load_date", "record_source", "hash_diff")]
    return ended.select(parent_hk, "load_date", "load_end_date", "record_source", "hash_diff", *attributes)


def merge_history(
    existing: DataFrame, staged: DataFrame, parent_hk: str, chunk: str | None = "month"
) -> DataFrame:
    """Whole satellite after a load. Late rows are put in their place.

    Only keys in `staged` are worked out again; a reload of a (key, load date) replaces it. Both
    inputs are read more than once: hand in tables, or staged rows cut to the checkpoint folder.
    """
    touched = staged.select(parent_hk)  # not distinct: semi joins need none, and a hot key can then be split
    old = existing.drop("load_end_date").join(touched, parent_hk, "left_semi")
    kept = old.join(staged.select(parent_hk, "load_date"), [parent_hk, "load_date"], "left_anti")
    redone = history(kept.unionByName(staged), parent_hk, chunk)
    return existing.join(touched, parent_hk, "left_anti").unionByName(redone.select(*existing.columns))


def change_rates(
    staged: DataFrame, parent_hk: str, attributes: list[str], chunk: str | None = "month"
) -> DataFrame:
    """Per attribute, the share of a key's consecutive staged rows in which it changes.

    A guide to splitting satellites.
    """
    rows = staged.select(parent_hk, "load_date", F.struct(*attributes).alias("_now"))
    pairs = with_neighbour(rows, [parent_hk], "load_date", "_now", "_before", _chunk(chunk)).filter("_before IS NOT NULL")
    rates = [
        F.struct(
            F.lit(a).alias("attribute"),
            F.count("*").alias("steps"),
            F.count_if(~F.col(f"_now.{a}").eqNullSafe(F.col(f"_before.{a}"))).alias("changes"),
        )
        for a in attributes
    ]
    share = F.bround(F.col("changes") / F.greatest(F.col("steps"), F.lit(1)), 4)
    return pairs.agg(F.array(*rates).alias("r")).select(F.inline("r")).withColumn("change_rate", share)


def split(
    staged: DataFrame,
    parent_hk: str,
    groups: dict[str, list[str]],
    chunk: str | None = "month",
    algo: str = "sha256",
) -> dict[str, DataFrame]:
    """One satellite per attribute group, each with its own hash_diff."""
    out = {}
    for name, attributes in groups.items():
        part = staged.select(
            parent_hk, "load_date", "record_source",
            hash_diff(*[F.col(a) for a in attributes], algo=algo).alias("hash_diff"), *attributes,
        )
        out[name] = history(part, parent_hk, chunk)
    return out


def point_in_time(
    satellites: dict[str, DataFrame], parent_hk: str, start: str, end: str, every_days: int = 1
) -> DataFrame:
    """Per key and snapshot date, the load_date of each satellite's row valid at its midnight.

    Validity intervals of a key do not overlap, so each satellite row lists the snapshots it covers:
    the as-of lookup is a projection, and only merging several satellites needs a shuffle.
    """
    first = F.lit(start).cast("date")
    length = F.date_diff(F.lit(end).cast("date"), first) + 1

    def reached(c: Column) -> Column:
        """Number of the first snapshot at or after c."""
        days = F.date_diff(c.cast("date"), first) + F.when(c > F.date_trunc("day", c), 1).otherwise(0)
        return F.ceil(F.greatest(days, F.lit(0)) / F.lit(every_days)).cast("int")

    parts = None
    for name, sat in satellites.items():
        after_last = F.ceil(length / F.lit(every_days)).cast("int")
        ended = F.col("load_end_date").isNotNull()
        until = F.when(ended, F.least(reached(F.col("load_end_date")), after_last)).otherwise(after_last)
        covered = sat.select(
            parent_hk, F.col("load_date"), reached(F.col("load_date")).alias("_from"), (until - 1).alias("_to")
        ).filter("_from <= _to")
        one = covered.select(
            parent_hk, F.explode(F.sequence("_from", "_to")).alias("_no"), F.col("load_date").alias(f"{name}_load_date")
        ).select(
            parent_hk,
            F.date_add(first, F.col("_no") * F.lit(every_days)).cast("timestamp_ntz").alias("snapshot_date"),
            f"{name}_load_date",
        )
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    if len(satellites) == 1:
        return parts
    return parts.groupBy(parent_hk, "snapshot_date").agg(
        *[F.max(f"{name}_load_date").alias(f"{name}_load_date") for name in satellites]
    )


def bridge(link_df: DataFrame, hubs: dict[str, DataFrame], name: str) -> DataFrame:
    """Link rows, unique by their hash key, with the business keys of their hubs."""
    out = link_df.select(f"{name}_hk", *[f"{entity}_hk" for entity in hubs])
    for entity, hub_df in hubs.items():
        out = out.join(hub_df.drop("load_date", "record_source"), f"{entity}_hk")
    return out


def dimension(hub_df: DataFrame, satellites: list[DataFrame], hk: str) -> DataFrame:
    """Hub rows with the current row of each satellite."""
    out = hub_df.drop("load_date", "record_source")
    for sat in satellites:
        current = sat.filter(CURRENT).drop("load_date", "load_end_date", "record_source", "hash_diff")
        out = out.join(current, hk, "left")
    return out


def fact(
    df: DataFrame,
    dimensions: dict[str, list[str]],
    measures: dict[str, str],
    degenerate: list[str] | None = None,
    algo: str = "sha256",
) -> DataFrame:
    """Measures (aggregate expressions) at the grain of the given keys; summed first, hashed after."""
    degenerate = degenerate or []
    spelled = {e for e, c in dimensions.items() if any(isinstance(df.schema[k].dataType, T.StringType) for k in c)}
    # Text keys are summed by the key text that spellings share, others by their native columns.
    grain = {
        e: [F.when(~_missing(c), key_text(*[F.col(k) for k in c])).alias(f"_{e}_text")] if e in spelled
        else [F.col(k).alias(f"_{e}_{i}") for i, k in enumerate(c)]
        for e, c in dimensions.items()
    }
    sums = df.groupBy(*[g for columns in grain.values() for g in columns], *degenerate).agg(
        *[F.expr(m).alias(n) for n, m in measures.items()]
    )

    def dim_key(entity: str) -> Column:
        if entity in spelled:
            return F.coalesce(digest(F.col(f"_{entity}_text"), algo), zero_key(algo))
        columns = [f"_{entity}_{i}" for i, _ in enumerate(dimensions[entity])]
        return F.when(_missing(columns), zero_key(algo)).otherwise(hash_key(*[F.col(c) for c in columns], algo=algo))

    return sums.select(*[dim_key(entity).alias(f"{entity}_hk") for entity in dimensions], *degenerate, *measures)


def hub_candidates(columns: DataFrame, min_distinct: int, suffixes: str = HUB_SUFFIXES) -> DataFrame:
    """Key-like columns worth a hub: not a small lookup, not a date."""
    return columns.filter(
        F.lower("name").rlike(suffixes)
        & (F.col("distinct_count") >= min_distinct)
        & ~F.col("data_type").rlike("^(date|timestamp)")
    )


PREFIXES = {"hub": "HUB_", "link": "LNK_", "satellite": "SAT_", "dim": "DIM_", "fact": "FACT_"}


def entity_name(kind: str, *parts: str) -> str:
    return PREFIXES[kind] + "_".join(p.upper() for p in parts)


def snake_columns(df: DataFrame) -> DataFrame:
    """Column names in lower snake case."""

    def snake(name: str) -> str:
        parted = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
        return re.sub(r"[^a-z0-9]+", "_", parted).strip("_")

    return df.toDF(*[snake(c) for c in df.columns])


def missing_columns(df: DataFrame, kind: str, name: str, keys: list[str]) -> list[str]:
    """Mandatory columns an entity lacks. keys: business key, parent hash keys."""
    required = {
        "hub": [f"{name}_hk", "load_date", "record_source", *keys],
        "link": [f"{name}_hk", "load_date", "record_source", *keys],
        "satellite": [f"{name}_hk", "load_date", "load_end_date", "record_source", "hash_diff"],
    }.get(kind, keys)
    return [c for c in required if c not in df.columns]


def uncovered_columns(source: T.StructType, produced: list[DataFrame], renamed: dict[str, str] | None = None) -> list[str]:
    """Source columns no hub, link or satellite holds."""
    held = {c for df in produced for c in df.columns}
    return [f.name for f in source if (renamed or {}).get(f.name, f.name) not in held]
