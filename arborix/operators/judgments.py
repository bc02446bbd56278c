"""A versioned graph of judgments: histories of events, their current state, and checks of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What ids and types of relations look like (fixed values).
ID, RELATION = r"^[a-z0-9][a-z0-9._:-]{0,127}$", r"^[a-z][a-z0-9_-]{0,63}$"
#: Actions that begin a judgment: an import brings its own revision, and may bring a past life.
BEGIN = {"add": "active", "import": "active", "import_archived": "archived", "import_superseded": "superseded"}
RELATIONS = "array<struct<target_id:string,relation_type:string>>"
RECORD = f"judgment_id string, revision int, statement string, rationale string, provenance map<string,string>, lifecycle string, superseded_by string, relations {RELATIONS}"


def replayed(events: DataFrame) -> DataFrame:
    """events(judgment_id, seq, action, expected_revision, statement, rationale) with revision, lifecycle and reject_code.

    An add or an import begins a judgment, an import at expected_revision; the others must name the current revision (a
    null is a conflict), and updates need an active one; archive and restore must change something; a superseded judgment
    can be neither changed nor restored; only archived ones can be deleted, and then added anew. What an event may do
    depends on accepted ones before it, so each judgment's history is one array, folded with built-in functions; a
    judgment has few events."""
    line = F.struct("seq", "action", "expected_revision", "statement", "rationale")
    state = "struct<revision:int,lifecycle:string,out:array<struct<seq:bigint,reject_code:string,revision:int,lifecycle:string>>>"

    def step(s, e):  # noqa: ANN001, ANN202
        a, life, begins = e.action, s.lifecycle, e.action.isin(*BEGIN)
        live = life == "active"
        code = (
            F.when(begins & (life != "absent"), "already_exists")
            .when(~begins & (life == "absent"), "unknown_judgment")
            .when((life == "superseded") & ~begins, "superseded")
            .when(a.isin("update", "supersede") & ~live, "not_active")
            .when(~begins & ~F.coalesce(e.expected_revision == s.revision, F.lit(False)), "revision_conflict")
            .when((a == "archive") & ~live | (a == "restore") & (life != "archived"), "no_change")
            .when((a == "delete") & (life != "archived"), "not_archived")
        )
        fine = code.isNull()
        revision = F.when(fine & (a == "add"), 1).when(fine & begins, e.expected_revision).when(fine & (a == "update"), s.revision + 1).otherwise(s.revision)
        born = F.coalesce(*(F.when(a == k, v) for k, v in BEGIN.items()))
        new = F.when(fine & begins, born).when(fine & (a == "restore"), "active").when(fine & (a == "archive"), "archived").when(fine & (a == "supersede"), "superseded").when(fine & (a == "delete"), "absent").otherwise(life)
        row = F.struct(e.seq.cast("bigint").alias("seq"), code.alias("reject_code"), revision.cast("int").alias("revision"), new.alias("lifecycle"))
        return F.struct(revision.cast("int").alias("revision"), new.alias("lifecycle"), F.concat(s.out, F.array(row)).alias("out")).cast(state)

    begin = F.struct(F.lit(0).alias("revision"), F.lit("absent").alias("lifecycle"), F.array().alias("out")).cast(state)
    done = events.groupBy("judgment_id").agg(F.array_sort(F.collect_list(line)).alias("h")).select("judgment_id", F.explode(F.aggregate("h", begin, step).getField("out")).alias("o"))
    return events.join(done.select("judgment_id", "o.*"), ["judgment_id", "seq"])


def current(history: DataFrame) -> DataFrame:
    """judgment_id, revision, lifecycle, statement, rationale as of the last accepted event."""
    fine = history.where("reject_code is null")
    text = F.max_by(F.struct("statement", "rationale"), F.when(F.col("action").isin(*BEGIN, "update"), F.col("seq")))
    last = fine.groupBy("judgment_id").agg(F.max_by(F.struct("revision", "lifecycle"), "seq").alias("s"), text.alias("t"))
    return last.where("s.lifecycle <> 'absent'").select("judgment_id", "s.*", "t.*")


def relations(history: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type as of the last accepted add, import or update of each judgment that is there;
    the history also has relations, an array of targets and types."""
    fine = history.where("reject_code is null")
    own = F.max_by("relations", F.when(F.col("action").isin(*BEGIN, "update"), F.col("seq")))
    last = fine.groupBy("judgment_id").agg(own.alias("r"), F.max_by("lifecycle", "seq").alias("lifecycle"))
    return last.where("lifecycle <> 'absent'").select(F.col("judgment_id").alias("source_id"), F.inline("r"))


def exported(history: DataFrame) -> DataFrame:
    """The current judgments as records (RECORD): a superseded one is archived and names its successor; relations are in
    order. The history also has relations, provenance and successor_id."""
    fine = history.where("reject_code is null")
    when = F.when(F.col("action").isin(*BEGIN, "update"), F.col("seq"))
    heir = F.max_by("successor_id", F.when(F.col("action").isin("supersede", *BEGIN), F.col("seq")))
    more = fine.groupBy("judgment_id").agg(F.max_by("provenance", when).alias("provenance"), heir.alias("superseded_by"), F.array_sort(F.coalesce(F.max_by("relations", when), F.array().cast(RELATIONS))).alias("relations"))
    life = F.when(F.col("lifecycle") == "superseded", "archived").otherwise(F.col("lifecycle"))
    return current(history).join(more, "judgment_id").select("judgment_id", "revision", "statement", "rationale", "provenance", life.alias("lifecycle"), "superseded_by", "relations")


def import_errors(records: DataFrame) -> DataFrame:
    """reason, id of records (RECORD) that can't be imported as one graph; none, if all can.

    Ids must be well formed and unique; revisions start at 1; statement, rationale and provenance must not be empty; a
    judgment is active or archived; relations have a type, lead to other records and stand once; successors are records.
    Ids without a record are found by joins, so a graph may be of any size."""
    blank = lambda c: ~F.coalesce(F.regexp_like(c, F.lit(r"\S")), F.lit(False))
    own = {
        "invalid_identity": ~F.coalesce(F.regexp_like("judgment_id", F.lit(ID)), F.lit(False)),
        "invalid_revision": ~F.coalesce(F.col("revision") >= 1, F.lit(False)),
        "empty_statement": blank("statement"),
        "empty_rationale": blank("rationale"),
        "empty_provenance": F.coalesce(F.size("provenance"), F.lit(0)) < 1,
        "invalid_lifecycle": ~F.coalesce(F.col("lifecycle"), F.lit("active")).isin("active", "archived"),
    }
    name = F.coalesce("judgment_id", F.lit(""))
    told = lambda why, c: F.when(c, F.struct(F.lit(why).alias("reason"), name.alias("id")))
    bad = records.select(F.inline(F.filter(F.array(*(told(k, c) for k, c in own.items())), lambda x: x.isNotNull())))
    twice = records.groupBy("judgment_id").count().where("count > 1").select(F.lit("duplicate_identity").alias("reason"), name.alias("id"))
    r = records.select(F.col("judgment_id").alias("source_id"), F.inline("relations"))
    line = F.concat_ws(">", "source_id", "target_id", "relation_type")
    r = r.groupBy("source_id", "target_id", "relation_type").agg(F.count("*").alias("n"))
    loops = r.where("source_id = target_id").select(F.lit("self_relation").alias("reason"), line.alias("id"))
    copies = r.where("n > 1").select(F.lit("duplicate_relation").alias("reason"), line.alias("id"))
    kind = r.where(~F.coalesce(F.regexp_like("relation_type", F.lit(RELATION)), F.lit(False))).select(F.lit("invalid_relation_type").alias("reason"), line.alias("id"))
    ids = records.select(F.col("judgment_id").alias("target_id")).distinct()
    loose = r.join(ids, "target_id", "left_anti").select(F.lit("dangling_relation").alias("reason"), line.alias("id"))
    heirs = records.where("superseded_by is not null").join(ids.withColumnRenamed("target_id", "superseded_by"), "superseded_by", "left_anti").select(F.lit("unknown_successor").alias("reason"), name.alias("id"))
    return reduce(DataFrame.unionByName, [bad, twice, loops, copies, kind, loose, heirs])


def import_events(records: DataFrame, seq: int) -> DataFrame:
    """Records without errors as the events that begin their judgments."""
    action = F.when(F.col("superseded_by").isNotNull(), "import_superseded").when(F.col("lifecycle") == "archived", "import_archived").otherwise("import")
    return records.select("judgment_id", F.lit(seq).cast("long").alias("seq"), action.alias("action"), F.col("revision").alias("expected_revision"), *(F.regexp_replace(c, r"^\s+|\s+$", "").alias(c) for c in ("statement", "rationale")), F.array_sort(F.coalesce("relations", F.array().cast(RELATIONS))).alias("relations"), "provenance", F.col("superseded_by").alias("successor_id"))


def as_nodes(now: DataFrame) -> DataFrame:
    """The nodes that searches see: active judgments, statement and rationale as text."""
    return now.where("lifecycle = 'active'").select(F.col("judgment_id").alias("node_id"), F.concat_ws("\n\n", "statement", "rationale").alias("text"), F.lit(1.0).alias("confidence"))


def audit(now: DataFrame, relations: DataFrame) -> DataFrame:
    """reason, id: relations without an end, judgments with two successors, and supersession that doesn't match a lifecycle."""
    name = F.concat_ws(">", "source_id", "target_id", "relation_type")
    loose = [relations.join(now.select(F.col("judgment_id").alias(end)), end, "left_anti").select(F.lit(f"dangling_{end}").alias("reason"), name.alias("id")) for end in ("source_id", "target_id")]
    heirs = relations.where("relation_type = 'supersedes'")
    two = heirs.groupBy("target_id").count().where("count > 1").select(F.lit("duplicate_successor").alias("reason"), F.col("target_id").alias("id"))
    old = now.where("lifecycle = 'superseded'").select(F.col("judgment_id").alias("id"))
    named = heirs.select(F.col("target_id").alias("id")).distinct()
    odd = old.join(named, "id", "left_anti").select(F.lit("superseded_without_successor").alias("reason"), "id")
    even = named.join(old, "id", "left_anti").select(F.lit("successor_of_unsuperseded").alias("reason"), "id")
    return reduce(DataFrame.unionByName, [*loose, two, odd, even])


def chain_tips(packets: DataFrame, rounds: int = 32) -> DataFrame:
    """packet_id, tip of packets(packet_id, supersedes): the end of each chain of replacements, by doubling jumps. Chains
    that haven't ended after 2 ** rounds steps are cycles and have no tip."""
    from ..sources.lineage import cut

    after = packets.where("supersedes is not null").select(F.col("supersedes").alias("packet_id"), F.col("packet_id").alias("next"))
    at = cut(packets.select("packet_id").join(after, "packet_id", "left").select("packet_id", "next"))
    for _ in range(rounds):
        jump = at.select(F.col("packet_id").alias("next"), F.col("next").alias("far"), F.lit(True).alias("known"))
        new = cut(at.join(jump, "next", "left").select("packet_id", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("moved")))
        at = new.select("packet_id", "next")
        if new.where("moved").isEmpty():
            return at.select("packet_id", F.coalesce("next", "packet_id").alias("tip"))
    return at.join(new.where("moved").select("packet_id"), "packet_id", "left_anti").select("packet_id", F.coalesce("next", "packet_id").alias("tip"))


def sequence_gaps(slots: DataFrame) -> DataFrame:
    """slots(arm, slot, at) with gap and backwards: a slot that is skipped, a time that doesn't rise."""
    w = Window.partitionBy("arm").orderBy("slot")
    return slots.withColumn("gap", F.col("slot") - F.coalesce(F.lag("slot").over(w), F.col("slot") - 1) != 1).withColumn("backwards", F.coalesce(F.lag("at").over(w) >= F.col("at"), F.lit(False)))
