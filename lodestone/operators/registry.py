"""Code registry: two tables, ``entries`` and ``members``; codes are superseded, never deleted.

entries: cnmc, status, superseded_by, created_at, created_by, tier, canonical_description.
members: cnmc, cpse, code, legacy, rid, description, pos (order within the entry).
Sequence numbers go on from the largest ever issued; batches are issued by one writer.

Null sectors are the other sector, null categories the general one; a null tier is
an empty text. A record is held by one active code: assigning it again is refused.
Clusters without known records get no code. An empty list of clusters leaves the registry as
it is; unknown codes are refused by name; ties of descriptions go to the first
member. Other columns of records are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators.order import with_rank
from lodestone.storage import materialize

ACTIVE, SUPERSEDED = "active", "superseded"
ENTRIES = "cnmc string, status string, superseded_by string, created_at string, created_by string, tier string, canonical_description string"
MEMBERS = "cnmc string, cpse string, code string, legacy string, rid long, description string, pos long"


def category_short_code(c: Column) -> Column:
    """Three letters: GEN for none, first three of one word (padded X), two and one of two words, initials of three."""
    w = F.filter(F.split(F.coalesce(c, F.lit("")), "[^A-Za-z]+"), lambda x: x != "")
    at = lambda i, n: F.substring(F.get(w, F.lit(i)), 1, n)
    return (
        F.when(F.size(w) == 0, F.lit("GEN"))
        .when(F.size(w) == 1, F.rpad(F.upper(at(0, 3)), 3, "X"))
        .when(F.size(w) == 2, F.upper(F.concat(at(0, 2), at(1, 1))))
        .otherwise(F.upper(F.concat(at(0, 1), at(1, 1), at(2, 1))))
    )


def code_of(sector: Column, category: Column, sequence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in S.SECTOR_CODES.items() for x in kv])
    digits = sequence.cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), S.SEQUENCE_WIDTH - F.length(digits))), digits)
    return F.concat_ws("-", F.lit(S.CODE_PREFIX), F.coalesce(table[sector], F.lit(S.OTHER_SECTOR)), category_short_code(category), padded)


def sequence_of(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"-(\d+)$", 1), F.lit("")).try_cast("long")


def canonical_description() -> Column:
    """The longest description of the members, the first on ties."""
    return F.max_by("description", F.struct(F.length("description"), -F.col("pos")))


@dataclass
class Registry:
    entries: DataFrame
    members: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Registry:
        return Registry(spark.createDataFrame([], ENTRIES), spark.createDataFrame([], MEMBERS))

    def next_sequence(self) -> int:
        return (self.entries.agg(F.max(sequence_of(F.col("cnmc")))).first()[0] or 0) + 1

    def _reverse(self) -> DataFrame:
        """(cpse, code, cnmc): where a record's code points now; the active entry wins, then the latest issued."""
        own = self.members.join(self.entries.where("status = 'active' or superseded_by is not null").select("cnmc", "status"), "cnmc")
        return own.groupBy("cpse", "code").agg(F.max_by("cnmc", F.struct((F.col("status") == ACTIVE), sequence_of(F.col("cnmc")))).alias("cnmc"))

    def _mapped(self) -> DataFrame:
        """(cpse, code) of the records that an active code holds, by itself or through the codes it absorbed."""
        merged = not self.entries.where("superseded_by is not null").isEmpty()
        live = self.resolve_all().where("resolved is not null") if merged else self.entries.where(F.col("status") == ACTIVE)
        return self.members.join(live.select("cnmc"), "cnmc", "left_semi").select("cpse", "code")

    def assign(self, clusters: DataFrame, records: DataFrame, created_by: str = "system", created_at: str | None = None) -> Registry:
        """Issues a code to every cluster (cluster_id, members, tier), in the order of cluster_id."""
        start = self.next_sequence()
        at = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        m = clusters.select("cluster_id", "tier", F.posexplode("members").alias("pos", "rid"))
        r = records.select("rid", F.col(S.OWNER).alias("cpse"), F.col(f"`{S.CODE}`").alias("code"), F.col(S.LEGACY).alias("legacy"), F.col(f"`{S.RAW}`").alias("description"), F.col(S.SECTOR).alias("sector"), F.col(f"`{S.CATEGORY}`").alias("category"))
        rows = m.join(r, "rid")
        already = rows.join(self._mapped(), ["cpse", "code"], "left_semi").limit(3).collect()
        if already:
            raise ValueError(f"records already mapped to a code: {[(x.cpse, x.code) for x in already]}; merge codes instead of assigning again")
        first = with_rank(rows.where("pos = 0").select("cluster_id", "tier", "sector", "category"), ["cluster_id"], "place")
        first = first.select("cluster_id", "tier", code_of(F.col("sector"), F.col("category"), F.col("place") + start).alias("cnmc"))
        first = materialize(first, "registry-codes")
        made = materialize(rows.drop("tier").join(first, "cluster_id").select("cnmc", "cpse", "code", "legacy", "rid", "description", F.col("pos").cast("long").alias("pos")), "registry-members")
        text = made.groupBy("cnmc").agg(canonical_description().alias("canonical_description"))
        entries = first.join(text, "cnmc").select("cnmc", F.lit(ACTIVE).alias("status"), F.lit(None).cast("string").alias("superseded_by"), at.alias("created_at"), F.lit(created_by).alias("created_by"), F.coalesce("tier", F.lit("")).alias("tier"), "canonical_description")
        return Registry(self.entries.unionByName(materialize(entries, "registry-entries")), self.members.unionByName(made))

    def _known(self, *codes: str) -> None:
        found = {r.cnmc for r in self.entries.where(F.col("cnmc").isin(*codes)).select("cnmc").collect()}
        for c in codes:
            if c not in found:
                raise KeyError(f"unknown code {c!r}")

    def merge(self, keep: str, absorb: str) -> Registry:
        """The survivor gains the members; the absorbed code points to it and keeps its own."""
        if keep == absorb:
            raise ValueError("can't merge a code into itself")
        self._known(keep, absorb)
        n = self.members.where(F.col("cnmc") == keep).agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
        members = self.members.unionByName(self.members.where(F.col("cnmc") == absorb).withColumn("cnmc", F.lit(keep)).withColumn("pos", F.col("pos") + n))
        text = members.where(F.col("cnmc") == keep).agg(canonical_description()).first()[0]
        gone = F.col("cnmc") == absorb
        entries = self.entries.withColumns({
            "status": F.when(gone, F.lit(SUPERSEDED)).otherwise(F.col("status")),
            "superseded_by": F.when(gone, F.lit(keep)).otherwise(F.col("superseded_by")),
            "canonical_description": F.when(F.col("cnmc") == keep, F.lit(text)).otherwise(F.col("canonical_description")),
        })
        return Registry(entries, members)

    def split(self, code: str, groups: list[list[int]], records: DataFrame, actor: str = "system") -> Registry:
        """New codes for an exact partition of the members; the original has no successor."""
        self._known(code)
        held = sorted(r.rid for r in self.members.where(F.col("cnmc") == code).select("rid").collect())  # one entry
        if sorted(x for g in groups for x in g) != held:
            raise ValueError(f"split groups must partition the members exactly: {sum(map(len, groups))} records for {len(held)}")
        tier = self.entries.where(F.col("cnmc") == code).first().tier
        closed = Registry(self.entries.withColumn("status", F.when(F.col("cnmc") == code, F.lit(SUPERSEDED)).otherwise(F.col("status"))), self.members)
        spark = records.sparkSession
        return closed.assign(spark.createDataFrame([(i, list(g), tier) for i, g in enumerate(groups)], "cluster_id long, members array<long>, tier string"), records, actor)

    def lookup(self, code: str) -> DataFrame:
        return self.members.where(F.col("cnmc") == code).orderBy("pos")

    def resolve_all(self, depth: int = 64) -> DataFrame:
        """(cnmc, resolved): the active code at the end of each chain; null where a chain ends without one.

        Steps are doubled: after k joins a code has moved 2^k steps. A cycle ends where it is.
        """
        live = materialize(self.entries.select("cnmc", "status", "superseded_by"), "registry-chain")
        cur = live.select("cnmc", F.when(F.col("status") == ACTIVE, F.col("cnmc")).otherwise(F.col("superseded_by")).alias("to"))
        for _ in range(depth.bit_length()):
            nxt = cur.select(F.col("cnmc").alias("_c"), F.col("to").alias("_t"))
            cur = materialize(cur.join(nxt, F.col("to") == F.col("_c"), "left").select("cnmc", F.when(F.col("_c").isNull(), F.lit(None)).otherwise(F.col("_t")).alias("to")), "registry-chain")
        return cur.select("cnmc", F.col("to").alias("resolved"))

    def resolve(self, code: str) -> str | None:
        row = self.resolve_all().where(F.col("cnmc") == code).first()
        return row.resolved if row else None

    def reverse_lookup(self, cpse: str, code: str) -> str | None:
        row = self._reverse().where((F.col("cpse") == cpse) & (F.col("code") == code)).first()
        return self.resolve(row.cnmc) if row else None

    def to_frame(self) -> DataFrame:
        return self.entries.join(self.members, "cnmc").select(
            F.col("cnmc").alias("CNMC"), F.col("status").alias("Status"), F.coalesce("superseded_by", F.lit("")).alias("Superseded_By"), F.col("cpse").alias("CPSE"),
            F.col("code").alias("CPSE_Material_Code"), F.col("legacy").alias("Legacy_Sector_Code"), F.col("description").alias("Raw_Description"),
            F.col("canonical_description").alias("Canonical_Description"), F.col("tier").alias("Confidence_Tier"), F.col("created_at").alias("Created_At"), F.col("created_by").alias("Created_By"),
        )

    def stats(self) -> DataFrame:
        """One row: codes_issued, active_codes, cross_cpse_codes, records_mapped, codes_eliminated."""
        m = self.members.groupBy("cnmc").agg(F.count("*").alias("n"), F.count_distinct("cpse").alias("o"))
        live = F.col("status") == ACTIVE
        out = self.entries.join(m, "cnmc", "left").agg(
            F.count("*").alias("codes_issued"), F.count_if(live).alias("active_codes"), F.count_if(live & (F.col("o") > 1)).alias("cross_cpse_codes"),
            F.coalesce(F.sum(F.when(live, F.col("n"))), F.lit(0)).alias("records_mapped"),
        )
        return out.withColumn("codes_eliminated", F.col("records_mapped") - F.col("active_codes"))

    def export_mapping(self, path: str) -> None:
        self.to_frame().coalesce(1).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def import_mapping(spark: SparkSession, path: str, records: DataFrame) -> Registry:
    """The registry of an exported mapping; rids by (owner, code), -1 where unknown; blank successors are none."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    r = records.select(F.col(S.OWNER).alias("CPSE"), F.col(f"`{S.CODE}`").alias("CPSE_Material_Code"), "rid").groupBy("CPSE", "CPSE_Material_Code").agg(F.max("rid").alias("rid"))
    joined = rows.join(r, ["CPSE", "CPSE_Material_Code"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    entries = rows.groupBy(F.col("CNMC").alias("cnmc")).agg(
        F.min("Status").alias("status"), F.min(F.nullif(F.trim("Superseded_By"), F.lit(""))).alias("superseded_by"), F.min(blank("Created_At")).alias("created_at"),
        F.min(blank("Created_By")).alias("created_by"), F.min(blank("Confidence_Tier")).alias("tier"), F.min(blank("Canonical_Description")).alias("canonical_description"),
    )
    pos = F.row_number().over(Window.partitionBy("CNMC").orderBy("rid", "CPSE", "CPSE_Material_Code")) - 1
    members = joined.select(F.col("CNMC").alias("cnmc"), F.col("CPSE").alias("cpse"), F.col("CPSE_Material_Code").alias("code"), blank("Legacy_Sector_Code").alias("legacy"), F.coalesce("rid", F.lit(-1)).alias("rid"), blank("Raw_Description").alias("description"), pos.cast("long").alias("pos"))
    return Registry(materialize(entries, "registry-import"), materialize(members, "registry-import"))
