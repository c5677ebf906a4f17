"""Merging successive states of one procurement: rank-aware and lifecycle-aware rules.

Both merges are one equi-join on the merge key, so a run costs one shuffle of each side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from ..functions.notices import lifecycle, overlap_lifecycle, status_of_type, status_rank
from ..functions.semantics import coalesce_truthy, earliest, latest, truthy
from ..functions.tables import CONFLICT_FIELDS, KEPT_FROM_PRODUCTION, PROVENANCE_PREFIXES, UNITED_LISTS
from .dedup import best_of


def merge_key(*columns: Column) -> Column:
    """The first column that is not missing: folder id, canonical key, id, url."""
    return coalesce_truthy(*columns)


def united(base: Column, incoming: Column, key=None) -> Column:
    """base as it is, then the elements of incoming whose key base does not have, each once.

    A null list counts as empty. Without ``key`` whole elements are compared, by hashing.
    """
    empty = F.slice(F.coalesce(base, incoming), 1, 0)
    base, incoming = F.coalesce(base, empty), F.coalesce(incoming, empty)
    if key is None:
        return F.concat(base, F.array_except(incoming, base))
    keys = F.transform(incoming, key)
    fresh = F.transform(F.array_except(keys, F.transform(base, key)), lambda k: F.element_at(incoming, F.array_position(keys, k).cast("int")))
    return F.concat(base, fresh)


def fields_key(*names: str):
    """A key of structs: the given fields as texts, a missing one as ''."""
    return lambda x: F.struct(*(F.coalesce(x[n].cast("string"), F.lit("")).alias(n) for n in names))


def united_sets(a: Column, b: Column) -> Column:
    """Sorted union of two arrays of strings."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def change_note(awardee: Column, before: Column, after: Column) -> Column:
    named = (after == "Adjudicado") & (F.coalesce(awardee, F.lit("")) != "")
    return F.when(named, F.concat(F.lit("Adjudicado a "), awardee)).otherwise(F.concat(F.lit("Cambio: "), before, F.lit(" → "), after))


#: Lists that a merge unites, with the fields that make two elements the same.
LIST_KEYS = {
    "notice_history": ("notice_id", "notice_type", "issue_date"),
    "award_results": ("notice_id", "winning_party_name", "winning_party_nif", "award_amount_tax_excl", "contract_id", "lot_id"),
    "documents": ("title", "url", "document_type", "notice_id"),
    "historial": ("data", "estat", "nota"),
}
#: Fields that the other side fills where the base has none.
FILLED = ("pressupost", "organisme", "url", "font", "disciplines", "kw", "enrichment_version", "tipus", "ambit", "estat_raw", "data_pub", "adjudicatari")


def _kind(t: DataType) -> str:
    return "string" if isinstance(t, StringType) else "array" if isinstance(t, ArrayType) else "number"


def _with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with the columns that only other has, as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in df.columns})


def best_award_name(results: Column) -> Column:
    """The winner named by the award of the highest notice rank, the first of them."""
    ranks = F.transform(results, lambda a: status_rank(F.coalesce(a["notice_type"], F.lit("UNKNOWN"))))
    return F.when(F.size(results) > 0, F.element_at(results, F.array_position(ranks, F.array_max(ranks)).cast("int"))["winning_party_name"])


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """df with ``_deal``, which says that a row is there: 0, or for a null key a number that spreads such rows over the join's tasks."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name != key]
    return df.withColumn("_deal", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(1009)) if plain else 0).otherwise(0).cast("int"))


def rank_merge(previous: DataFrame, incoming: DataFrame, today: str, key: str = "ckey") -> DataFrame:
    """Full outer merge of two states; one row for each key on either side, with all columns of both.

    The side of higher rank (by notice_type) is the base, the previous one on a tie. The
    lists of LIST_KEYS are united, sources_seen, related_contract_ids and the
    comma-separated cpv as sorted sets. The columns of FILLED, blank in the base, come from
    the other side, adjudicatari also from the award of highest rank; id, contract_folder_id
    and data_limit are the previous ones unless blank; the first date is the earliest and
    the last the latest. All other columns are the base's. A change of status adds a line of
    history. Both sides need the key, notice_type, estat, adjudicatari, data_pub and
    historial, each key once; a column that one side lacks is null there. Rows with a null
    key meet none: each comes out as it is, new or preserved.
    """
    previous, incoming = _with_columns_of(previous, incoming), _with_columns_of(incoming, previous)
    kinds = {f.name: f.dataType for f in previous.schema}
    p, n = _dealt(previous, key).alias("p"), _dealt(incoming, key).alias("n")
    j = p.join(n, (F.col(f"p.{key}") == F.col(f"n.{key}")) & (F.col("p._deal") == F.col("n._deal")), "full_outer")
    has_p, has_n = F.col("p._deal").isNotNull(), F.col("n._deal").isNotNull()
    rank_p, rank_n = (status_rank(F.coalesce(F.col(f"{s}.notice_type"), F.lit("UNKNOWN"))) for s in "pn")
    wins, both = has_n & (~has_p | (rank_n > rank_p)), has_p & has_n
    side = lambda c: F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"p.{c}"))
    other = lambda c: F.when(wins, F.col(f"p.{c}")).otherwise(F.col(f"n.{c}"))
    firm = lambda c: coalesce_truthy(F.col(f"p.{c}"), F.col(f"n.{c}"), default=F.lit(""))
    kind = F.coalesce(side("notice_type"), F.lit("UNKNOWN"))
    was, now = F.coalesce(truthy(F.col("p.estat")), F.lit("Vigente")), status_of_type(F.col("n.notice_type"), rank_n)
    entry = lambda date, state, note: F.array(F.struct(date.alias("data"), state.alias("estat"), note.alias("nota")))
    unite = lambda c: united(side(c), other(c), fields_key(*LIST_KEYS[c]))

    def codes(c: Column) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    def filled(c: str) -> Column:
        k = _kind(kinds[c])
        return F.coalesce(truthy(side(c), k), truthy(other(c), k), side(c) if k != "string" else F.lit(""))

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"p.{key}"), F.col(f"n.{key}"))
        if c == "notice_type":
            return kind
        if c == "estat":
            return F.when(both, status_of_type(kind, F.greatest(rank_p, rank_n))).otherwise(F.coalesce(F.col("p.estat"), F.col("n.estat")))
        if c in ("id", "contract_folder_id", "data_limit") and _kind(kinds[c]) == "string":
            return firm(c)
        if c == "first_pub_date":
            return earliest(F.col(f"p.{c}"), F.col(f"n.{c}"))
        if c == "last_notice_date":
            return latest(F.col(f"p.{c}"), F.col(f"n.{c}"))
        if c in ("sources_seen", "related_contract_ids"):
            return united_sets(F.col(f"p.{c}"), F.col(f"n.{c}"))
        if c == "cpv":
            return F.when(both, F.array_join(F.array_sort(F.array_union(codes(F.col("p.cpv")), codes(F.col("n.cpv")))), ",")).otherwise(side(c))
        if c == "historial":
            history = unite(c)
            published = entry(F.coalesce(side("data_pub"), F.lit(today)), F.coalesce(side("estat"), F.lit("Vigente")), F.lit("Publicación"))
            changed = F.concat(history, entry(F.lit(today), now, change_note(F.col("n.adjudicatari"), was, now)))
            return F.when(both & wins & (now != was), changed).when((F.size(history) > 0) | both & wins | has_p & ~has_n, history).otherwise(published)
        if c == "award_results":
            return F.col("_awards")
        if c in LIST_KEYS:
            return unite(c)
        if c == "adjudicatari":
            return F.coalesce(truthy(filled(c)), award, F.lit(""))
        return filled(c) if c in FILLED else side(c)

    if "award_results" in kinds:
        j = j.withColumn("_awards", unite("award_results"))  # once, for the list and for the winner it names
    award = truthy(best_award_name(F.col("_awards"))) if "award_results" in kinds else F.lit(None).cast("string")
    columns = [merged(c).alias(c) for c in previous.columns if c != "winner_provenance"]
    if "award_results" in kinds:
        given = F.col("p.winner_provenance"), F.col("n.winner_provenance")
        given = F.when(wins, given[1]).otherwise(given[0]) if "winner_provenance" in kinds else F.lit(None).cast("string")
        columns.append(F.when(both & truthy(filled("adjudicatari")).isNull() & award.isNotNull(), "feed_xml").otherwise(given).alias("winner_provenance"))
    return j.select(*columns, F.when(both, "updated").when(has_n, "new").otherwise("preserved").alias("outcome"))


def merge_stats(merged: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return merged.groupBy("outcome").agg(F.count("*").alias("n"))


def candidate_fields(columns: Sequence[str]) -> list[str]:
    """Fields that a candidate may overwrite in production."""
    return [c for c in columns if c not in KEPT_FROM_PRODUCTION and c not in UNITED_LISTS and not c.startswith(PROVENANCE_PREFIXES)]


def lifecycle_merge(production: DataFrame, candidates: DataFrame, key: str, position: str, fields: Sequence[str], lists: Sequence[str] = (), present: str | None = None, conflicts: bool = False) -> DataFrame:
    """Production rows, each merged with the first candidate of its key, then candidates of new keys.

    Both tables have (key, estat, adjudicatari, fields, lists); production also has
    lifecycle_category and lifecycle_review_required. A field that the candidate has
    overwrites production's, even with null, if ``present`` names a column with the
    candidate's own field names; without it a null counts as absent. Candidates with a null
    key, and all candidates of a new key, are added. A null list counts as empty, unless both
    are null. With ``conflicts`` a column of that name lists the scalars of CONFLICT_FIELDS in
    which the two differ.
    """
    first = best_of(candidates.where(F.col(key).isNotNull()), [key], [-F.col(position)]).alias("c")
    p = production.alias("p")
    j = p.join(first, F.col(f"p.{key}") == F.col(f"c.{key}"), "left")
    met = F.col(f"c.{key}").isNotNull()

    def given(c: str) -> Column:
        return F.array_contains(F.col(f"c.{present}"), c) if present else F.col(f"c.{c}").isNotNull()

    def taken(c: str) -> Column:
        return F.when(met & given(c), F.col(f"c.{c}")).otherwise(F.col(f"p.{c}")).alias(c)

    has_award = F.coalesce(F.col("c.adjudicatari") != "", F.lit(False))
    after = overlap_lifecycle(F.col("c.estat"), has_award, F.col("p.lifecycle_category"), F.col("p.lifecycle_review_required"))
    kept = F.struct(F.col("p.lifecycle_category").alias("category"), F.coalesce(F.col("p.lifecycle_category") == "CLEAR_OPEN", F.lit(False)).alias("active"), F.coalesce(F.col("p.lifecycle_review_required"), F.lit(False)).alias("review"))
    life = F.when(met, after).otherwise(kept)
    columns = ["estat", "adjudicatari", *fields]
    lists_out = [F.when(met, united(F.col(f"p.{c}"), F.col(f"c.{c}"))).otherwise(F.col(f"p.{c}")).alias(c) for c in lists]
    clash = [F.when(met & given(c) & ~F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")), F.struct(F.lit(c).alias("key"), F.col(f"p.{c}").cast("string").alias("production"), F.col(f"c.{c}").cast("string").alias("candidate"))) for c in columns if c in CONFLICT_FIELDS]
    none = F.array().cast("array<struct<key:string,production:string,candidate:string>>").alias("conflicts")
    clashes = F.array_compact(F.array(*clash)).alias("conflicts") if clash else none
    merged = j.select(F.col(f"p.{key}").alias(key), *map(taken, columns), *lists_out, clashes, life.alias("life"), F.when(met, "overlap").otherwise("production_only").alias("outcome"))
    new = candidates.join(production.select(key).distinct(), key, "left_anti")
    alone = lifecycle(F.col("estat"), F.coalesce(F.col("adjudicatari") != "", F.lit(False)))
    added = new.select(key, *columns, *lists, none, alone.alias("life"), F.lit("candidate_only").alias("outcome"))
    out = merged.unionByName(added)
    out = out if conflicts else out.drop("conflicts")
    return out.select("*", F.col("life.category").alias("lifecycle_category"), F.col("life.active").alias("active"), F.col("life.review").alias("review")).drop("life")


def integrity_violations(merged: DataFrame) -> DataFrame:
    """Rows that are active although there is evidence of an award."""
    return merged.where((F.col("lifecycle_category") == "OPEN_WITH_AWARD_EVIDENCE") & F.col("active"))
