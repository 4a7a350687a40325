"""Audit checks: (code, count, detail) for every check that finds something; no rows mean all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators import canonical, timeline


def _codes(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass over df: how many rows each condition holds for."""
    one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("code"), F.col(f"c{i}").alias("count")) for i, k in enumerate(checks)])
    return one.select(F.inline(rows)).filter("count > 0").withColumn("detail", F.lit("rows"))


def _count(df: DataFrame, code: str, detail: str) -> DataFrame:
    return df.agg(F.count("*").alias("count")).filter("count > 0").select(F.lit(code).alias("code"), "count", F.lit(detail).alias("detail"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame([("schema-missing-column", 1, c) for c in missing], "code string, count long, detail string")


def _totals(one: DataFrame, checks: dict[str, Column], detail: str = "facts") -> DataFrame:
    """one: a single row. How many facts of each check are wrong there."""
    rows = F.array(*[F.struct(F.lit(k).alias("code"), c.cast("long").alias("count")) for k, c in checks.items()])
    return one.select(F.inline(rows)).filter("count > 0").withColumn("detail", F.lit(detail))


def _wrong(*facts: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(True)).cast("int") for f in facts])


RUN_COUNTS = (
    "selected_snapshots", "selected_sources", "source_conversations", "source_messages",
    "output_conversations", "output_messages", "output_texts", "deduplicated",
)


def audit_run(runs: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """runs: the receipts of a store (status, completed_at and RUN_COUNTS), which should be one; null counts are 0.

    A receipt must be complete and dated, its source counts positive and equal to what came out and what was
    dropped as duplicates, and its output counts those of the store. These are judged only if there is one receipt.
    """
    held = runs.agg(F.count("*").alias("n"), F.max("status").alias("status"), F.max("completed_at").alias("completed_at"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in RUN_COUNTS])
    have = messages.agg(F.count("*").alias("m"), F.count_if((F.col("type") == 1) & (F.length("text") > 0)).alias("t"))
    one = held.crossJoin(have).crossJoin(conversations.agg(F.count("*").alias("c")))  # one row each
    n, r = F.col("n"), F.col
    only = lambda c: F.when(n == 1, c).otherwise(0)
    positive = [r(c) <= 0 for c in ("selected_snapshots", "selected_sources", "source_conversations", "source_messages")]
    return _totals(one, {
        "parse-run-record-count": F.when(n == 1, 0).otherwise(F.greatest(F.lit(1), F.abs(n - 1))),
        "empty-output": _wrong(r("c") == 0, r("m") == 0),
        "parse-run-not-complete": only(F.greatest(_wrong(r("status") != "complete"), _wrong(F.trim("completed_at") == ""))),
        "parse-run-source-output-mismatch": only(_wrong(
            *positive, r("source_conversations") != r("output_conversations"), r("source_messages") != r("output_messages") + r("deduplicated"))),
        "parse-run-database-count-mismatch": only(_wrong(
            r("output_conversations") != r("c"), r("output_messages") != r("m"), r("output_texts") != r("t"))),
    })


def audit_duplicates(m: DataFrame) -> DataFrame:
    sid = m.filter(scalars.clean_server_id(F.col("server_id")).isNotNull())
    return _all([
        _count(canonical.duplicates(m, ["message_uid"]), "duplicate-message-uid", "groups"),
        _count(canonical.duplicates(m, ["conv_id", "source_db", "local_id"]), "duplicate-evidence-key", "groups"),
        _count(canonical.duplicates(sid, ["conv_id", "server_id"]), "duplicate-server-id", "groups"),
    ])


def _blank(c: str) -> Column:
    return scalars.blank_to_null(F.col(c).cast("string")).isNull()


def _checks(zone: str) -> dict[str, dict[str, Column]]:
    """Row conditions by family; one pass may take any of them together."""
    day = scalars.archive_day(F.col("occurred_at_epoch_s"), zone)
    return {
        "provenance": {"missing-provenance": _blank("source_db") | _blank("source_adapter") | _blank("local_id")}, "types": {"message-type-not-normalized": scalars.norm_type(F.col("raw_type")) != F.col("type")},
        "encoding": {"replacement-character": F.col("text").contains("�") | F.col("sender").contains("�")},
        "canonical": {"archive-day-mismatch": ~F.col("archive_day").eqNullSafe(day), "canonical-message-fields-invalid": _blank("message_uid") | _blank("conv_id") | F.col("canonical_seq").isNull() | (F.col("canonical_seq") < 0)},
    }


def audit_provenance(m: DataFrame) -> DataFrame:
    return _codes(m, _checks("UTC")["provenance"])


def audit_types(m: DataFrame) -> DataFrame:
    return _codes(m, _checks("UTC")["types"])


def audit_encoding(m: DataFrame) -> DataFrame:
    return _codes(m, _checks("UTC")["encoding"])


def audit_canonical(m: DataFrame, zone: str) -> DataFrame:
    return _all([_codes(m, _checks(zone)["canonical"]), _count(timeline.same_second_order(m), "same-second-source-order-mismatch", "rows")])


def audit_messages(m: DataFrame, zone: str) -> DataFrame:
    """Provenance, types, encoding, days, duplicates and order of canonical messages; all row conditions in one pass."""
    rows = _codes(m, {k: c for family in _checks(zone).values() for k, c in family.items()})
    return _all([rows, audit_duplicates(m), _count(timeline.order_gaps(m), "message-order-not-monotonic", "rows"), _count(timeline.same_second_order(m), "same-second-source-order-mismatch", "rows")])


def audit_senders(m: DataFrame, members: DataFrame) -> DataFrame:
    """members: (conv_id, sender) pairs that are allowed in private chats. m: conv_id, is_group, sender, sender_prefix."""
    private = m.filter(~F.col("is_group") & (F.col("sender") != "")).join(members, ["conv_id", "sender"], "left_anti")
    return _all([_count(private, "private-sender-outside-participants", "rows"), _codes(m, {"group-prefix-sender-mismatch": F.col("is_group") & (F.col("sender_prefix") != "") & ~F.col("sender").eqNullSafe(F.col("sender_prefix"))})])


def audit_conversations(m: DataFrame, convs: DataFrame) -> DataFrame:
    """convs: conv_id, msg_count, text_count, owner, account. m: conv_id, canonical_seq, occurred_at_epoch_s, type, text, sender, is_own.

    Counters equal the rows, sequences have no gap and no step back in time, is_own is what the owner's id says
    (nothing for rows without a sender), and an owner has one account.
    """
    texts = F.count_if((F.col("type") == 1) & (F.trim("text") != ""))
    have = m.groupBy("conv_id").agg(F.count("*").alias("have"), texts.alias("texts"))
    j = convs.join(have, "conv_id", "left")
    off = lambda a, b: F.coalesce(a, F.lit(0)) != F.coalesce(b, F.lit(0))
    sent = m.filter(F.trim("sender") != "").join(convs.select("conv_id", "owner"), "conv_id")
    many = convs.groupBy("owner").agg(F.count_distinct("account").alias("n")).filter("n > 1")
    return _all([
        _codes(j, {"conversation-count-mismatch": off("msg_count", "have") | off("text_count", "texts")}),
        _count(timeline.order_gaps(m), "message-order-not-monotonic", "rows"),
        _codes(sent, {"is-own-mismatch": ~F.col("is_own").cast("boolean").eqNullSafe(F.col("sender") == F.col("owner"))}),
        _count(many, "duplicate-owner-snapshot", "owners"),
    ])


def audit_inventory(inventory: DataFrame, zone: str, version: int, want: int, run: DataFrame | None = None) -> DataFrame:
    """Counts per shard close and are not negative, the zone is a region or UTC, the schema version is the expected one.

    run: the receipt (one row: units, parsed, deduplicated, excluded) whose totals the inventory's must be.
    """
    bad_zone, bad_version = "/" not in zone and zone != "UTC", version != want
    parts = ("parsed", "deduplicated", "excluded")
    closed = F.col("discovered") == F.col("parsed") + F.col("deduplicated") + F.col("excluded")
    rows = [(c, 1, d) for c, d, bad in (("archive-time-zone-invalid", zone, bad_zone), ("canonical-schema-version", str(version), bad_version)) if bad]
    found = [
        _codes(inventory, {"source-inventory-count-mismatch": ~closed | (F.least("discovered", *parts) < 0)}),
        inventory.sparkSession.createDataFrame(rows, "code string, count long, detail string"),
    ]
    if run is not None:
        total = inventory.agg(F.count("*").alias("units_"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_") for c in parts])
        facts = _wrong(*[F.col(c) != F.col(f"{c}_") for c in ("units", *parts)])
        found.append(_totals(total.crossJoin(run.select("units", *parts)), {"source-inventory-run-mismatch": facts}))  # one row each
    return _all(found)


def audit_references(
    m: DataFrame, people: DataFrame, convs: DataFrame, run: DataFrame | None = None, metadata: DataFrame | None = None
) -> DataFrame:
    """m: conv_id, sender and person_id. people: person_id, owner, username. convs: conv_id and owner.

    Person ids are hashes of owner and username; a row with a sender names the person of that owner and username, one
    without names none; conversations and persons that rows name exist. run (one row: run_id, schema_version,
    time_zone) must be what metadata (key, value) says.
    """
    hashed = F.col("person_id").eqNullSafe(scalars.person_id(F.col("owner"), F.col("username")))
    p = people.select(F.col("person_id").alias("pid"), F.col("owner").alias("p_owner"), F.col("username").alias("p_name"))
    j = m.join(convs.select("conv_id", "owner", F.lit(True).alias("known")), "conv_id", "left").join(p, F.col("person_id") == F.col("pid"), "left")
    silent = F.trim(F.coalesce("sender", F.lit(""))) == ""
    meant = F.col("pid").isNotNull() & F.col("p_owner").eqNullSafe(F.col("owner")) & (F.col("p_name") == F.col("sender"))
    dangling = F.col("known").isNull().cast("int") + (F.col("person_id").isNotNull() & F.col("pid").isNull()).cast("int")
    missing = j.agg(F.coalesce(F.sum(dangling), F.lit(0)).alias("n"))
    parts = [
        _codes(people, {"person-id-mismatch": ~hashed}),
        _codes(j, {"message-person-reference-mismatch": F.when(silent, F.col("person_id").isNotNull()).otherwise(~meant)}),
        _totals(missing, {"foreign-key-violation": F.col("n")}, "rows"),
    ]
    if run is not None and metadata is not None:
        keys = ("run_id", "schema_version", "time_zone")
        said = metadata.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"{k}_") for k in keys])
        facts = _wrong(*[~F.col(k).cast("string").eqNullSafe(F.col(f"{k}_")) for k in keys])
        parts.append(_totals(said.crossJoin(run.select(*keys)), {"bundle-metadata-mismatch": facts}))  # one row each
    return _all(parts)


def audit_source(output: DataFrame, source: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return canonical.reconcile_source(output, source, fields).groupBy("code").agg(F.count("*").alias("count")).withColumn("detail", F.lit("rows"))


def audit_combined(chat: DataFrame, source: DataFrame) -> DataFrame:
    """Replacement characters that the canonical store has and its source has not: a decoding fault rather than data."""
    a, b = (x.agg(F.count_if(F.col("text").contains("�")).alias(n)) for x, n in ((chat, "a"), (source, "b")))
    return a.crossJoin(b).filter("a <> b").select(F.lit("replacement-character-unexplained").alias("code"), F.abs(F.col("a") - F.col("b")).alias("count"), F.lit("rows").alias("detail"))  # one row each


def audit_assets(assets: DataFrame) -> DataFrame:
    """assets: asset_id, status, message_uid, state, reason, candidates (number)."""
    return _codes(assets, {
        "asset-link": (F.col("status") == "confirmed") & F.col("message_uid").isNull(), "quarantined-asset": (F.col("status") == "quarantined") & F.col("message_uid").isNotNull(),
        "candidate-count": (F.col("status") == "confirmed") & (F.col("candidates") != 1), "failure-reason": (F.col("state") == "failed") & F.col("reason").isNull(), "success-reason": (F.col("state") == "present") & F.col("reason").isNotNull(),
    })


def audit_asset_files(assets: DataFrame, files: DataFrame) -> DataFrame:
    """assets (path, size, sha256) against files (path, size, sha256)."""
    j = assets.select("path", F.col("size").alias("want_size"), F.col("sha256").alias("want_sha")).join(files.select("path", "size", "sha256"), "path", "left")
    return _codes(j, {"file-missing": F.col("size").isNull(), "file-size": F.col("size") != F.col("want_size"), "file-digest": (F.col("size") == F.col("want_size")) & (F.col("sha256") != F.col("want_sha"))})


def audit_insights(nuggets: DataFrame, convs: DataFrame, categories: list[str]) -> DataFrame:
    """nuggets: conv_id, nugget_id, category, title, content, importance."""
    return _all([
        _codes(nuggets, {"insight-category": ~F.col("category").isin(*categories), "insight-title-length": ~F.length("title").between(1, 24), "insight-content-length": ~F.length("content").between(1, 140), "insight-importance": ~F.col("importance").between(1, 5)}),
        _count(canonical.duplicates(nuggets, ["nugget_id"]), "insight-duplicate-id", "groups"), _count(canonical.orphans(nuggets, convs), "insight-unknown-conversation", "rows"),
    ])


def audit_dependencies(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children: product, parent_kind, parent_run, parent_version, parent_digest; parents: kind, run_id, schema_version, digest.

    A product whose parent has no such run, schema version and digest, or that names no parent, is out of date.
    """
    of = {"parent_kind": "kind", "parent_run": "run_id", "parent_version": "schema_version", "parent_digest": "digest"}
    p = parents.select(*[F.col(b).alias(a) for a, b in of.items()])
    return _count(children.join(p, [*of], "left_anti"), "dependency_mismatch", "products")
