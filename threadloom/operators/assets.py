"""Evidence-checked links between messages, resources, voice rows and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import scalars, urls

FIELDS = ("message_uid", "chat_table", "local_id", "server_id", "normalized_type", "raw_type", "create_time")


def message_candidates(probes: DataFrame, messages: DataFrame) -> DataFrame:
    """(resource_id, message_uid) by any of three locators: uid; table and local id; table and server id. Three equi joins, as one OR would be a nested loop."""
    p, m = probes.alias("p"), messages.alias("m")
    sid = lambda c: scalars.clean_server_id(F.col(c).cast("string"))
    on = [
        F.col("p.message_uid") == F.col("m.message_uid"), (F.col("p.chat_table") == F.col("m.chat_table")) & (F.col("p.local_id") == F.col("m.local_id")),
        (F.col("p.chat_table") == F.col("m.chat_table")) & (sid("p.server_id") == sid("m.server_id")),
    ]
    parts = [p.join(m, c).select("p.resource_id", F.col("m.message_uid").alias("candidate_uid")) for c in on]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def align_resources(probes: DataFrame, messages: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """resource_id, verdict (exact, partial, missing, conflict), candidates, missing and conflicting (comma-joined).

    A field that the probe lacks is missing and never a match. One candidate that
    agrees on all supplied fields is exact, or partial if the probe lacks some; more than one candidate conflicts.
    """
    c = message_candidates(probes, messages)
    p = probes.select("resource_id", F.struct(*fields).alias("p"))
    m = messages.select(F.col("message_uid").alias("candidate_uid"), F.struct(*fields).alias("m"))
    j = p.join(c, "resource_id", "left").join(m, "candidate_uid", "left")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"p.{f}").isNull(), F.lit(f)) for f in fields]))
    clash = F.array_compact(F.array(*[F.when(F.col("m").isNotNull() & F.col(f"p.{f}").isNotNull() & ~F.col(f"p.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in fields]))
    g = j.select("resource_id", "candidate_uid", lacks.alias("lacks"), clash.alias("clash")).groupBy("resource_id").agg(
        F.count("candidate_uid").alias("candidates"), F.max("candidate_uid").alias("candidate_uid"), F.max("lacks").alias("lacks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("clash")))).alias("clash"),
    )
    verdict = F.when(F.col("candidates") == 0, "missing").when((F.col("candidates") > 1) | (F.size("clash") > 0), "conflict").when(F.size("lacks") > 0, "partial").otherwise("exact")
    return g.select("resource_id", verdict.alias("verdict"), F.when(verdict.isin("exact", "partial"), F.col("candidate_uid")).alias("message_uid"), "candidates", F.array_join("lacks", ",").alias("missing"), F.array_join("clash", ",").alias("conflicting"))


def align_voice(voice: DataFrame, messages: DataFrame) -> DataFrame:
    """voice_id, message_uid, status (unique, conflict, missing): within a chat every locator that the row has must agree, and for one message only.

    Two voice rows that claim one message both become conflicts.
    """
    m = messages.filter("type = 34").select(F.col("conv_id").alias("c"), "message_uid", F.col("local_id").alias("ml"), F.col("server_id").alias("ms"), F.col("occurred_at_epoch_s").alias("mt"))
    ms, vs = scalars.clean_server_id(F.col("ms").cast("string")), scalars.clean_server_id(F.col("server_id").cast("string"))
    any_ = (F.col("local_id") == F.col("ml")) | (vs == ms)
    by_local = voice.join(m, (F.col("conv_id") == F.col("c")) & (F.col("local_id") == F.col("ml")))
    by_server = voice.join(m, (F.col("conv_id") == F.col("c")) & (vs == ms))
    pairs = by_local.union(by_server).distinct()
    agree = F.coalesce(F.col("local_id") == F.col("ml"), F.lit(True)) & F.coalesce(vs == ms, F.lit(True)) & F.coalesce(F.col("occurred_at_epoch_s") == F.col("mt"), F.lit(True))
    g = pairs.groupBy("voice_id").agg(F.count_if(agree).alias("all_match"), F.count_if(any_).alias("any_match"), F.max(F.when(agree, F.col("message_uid"))).alias("uid"))
    v = voice.select("voice_id").join(g, "voice_id", "left")
    status = F.when(F.col("any_match").isNull(), "missing").when((F.col("all_match") == 1) & (F.col("any_match") == 1), "unique").otherwise("conflict")
    one = v.select("voice_id", status.alias("status"), F.when(status == "unique", F.col("uid")).alias("message_uid"))
    n = F.count("*").over(Window.partitionBy("message_uid"))
    claimed = one.filter("message_uid IS NOT NULL").withColumn("n", n).select("voice_id", F.when(F.col("n") > 1, "conflict").otherwise("unique").alias("status"), F.when(F.col("n") == 1, F.col("message_uid")).alias("message_uid"))
    return claimed.unionByName(one.filter("message_uid IS NULL"))


def match_files(resources: DataFrame, files: DataFrame) -> DataFrame:
    """resource_id, status, path, candidates. resources: resource_id, name, size, hashes; files: path, name, size.

    Files are found by a hash in their name, else by their lower-cased name; of several the size decides.
    """
    f = files.select("path", F.lower("name").alias("key"), F.col("size").alias("fsize"), scalars.lookup_hashes(F.col("name")).alias("hashes")).dropDuplicates(["path"])
    r = resources.select("resource_id", F.lower("name").alias("key"), "size", "hashes")
    by_hash = r.select("resource_id", "size", F.explode("hashes").alias("h")).join(f.select("path", "fsize", F.explode("hashes").alias("h")), "h").select("resource_id", "path", "size", "fsize", F.lit("hash").alias("how")).distinct()
    rest = r.join(by_hash.select("resource_id").distinct(), "resource_id", "left_anti")
    by_name = rest.join(f.select("path", "fsize", "key"), "key").select("resource_id", "path", "size", "fsize", F.lit("name").alias("how"))
    same = (F.col("size") == F.col("fsize")).cast("int")
    g = by_hash.union(by_name).groupBy("resource_id").agg(F.count("*").alias("candidates"), F.sum(F.coalesce(same, F.lit(0))).alias("sized"), F.max("how").alias("how"), F.min(F.when(same == 1, F.col("path"))).alias("sized_path"), F.min("path").alias("any_path"), F.max("size").alias("size"))
    s = (
        F.when(F.col("candidates").isNull(), "missing").when(F.col("size").isNotNull() & (F.col("sized") == 0), "size_mismatch")
        .when(F.when(F.col("size").isNull(), F.col("candidates")).otherwise(F.col("sized")) > 1, "ambiguous").when(F.col("how") == "hash", "exact").otherwise("filename_only")
    )
    out = resources.select("resource_id").join(g, "resource_id", "left")
    path = F.when(s.isin("exact", "filename_only"), F.coalesce("sized_path", "any_path"))
    return out.select("resource_id", s.alias("status"), path.alias("path"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def confirm_link(aligned: DataFrame) -> DataFrame:
    """aligned: verdict, message_conv, resource_conv, message_evidence, resource_evidence -> + confirmed, reason."""
    reason = (
        F.when(F.col("verdict") != "exact", F.concat(F.lit("alignment_"), "verdict")).when(~F.col("message_conv").eqNullSafe(F.col("resource_conv")), "other_conversation")
        .when(F.col("message_evidence").isNull() | F.col("resource_evidence").isNull(), "evidence_missing").when(F.col("message_evidence") != F.col("resource_evidence"), "evidence_differs")
    )
    return aligned.withColumn("reason", reason).withColumn("confirmed", F.col("reason").isNull())


def link_artifacts(messages: DataFrame) -> DataFrame:
    """message_uid, position, url: every address of a message (text, and application_xml where there is one) in order, canonical and once."""
    xml = F.col("application_xml") if "application_xml" in messages.columns else None
    return messages.select("message_uid", F.posexplode(urls.extract_urls(F.col("text"), xml)).alias("position", "url"))


# What marks an artifact as a skill, a document or a work.
SKILL = r"(?iu)(?:^|[\s/_.-])skills?(?:[\s/_.-]|$)|skill\.md|技能包|技能工具"
DOCUMENT_PREVIEWS = ("pdf", "docx", "sheet", "presentation", "markdown", "text", "json")
WORK_PREVIEWS = ("image", "video", "audio", "voice", "html", "code")
DOCUMENT = r"(?iu)\.(?:pdf|docx?|pptx?|ppsx|xlsx?|csv|md|markdown|txt|rtf)$"
WORK = r"(?iu)\.(?:avif|bmp|gif|heic|jpe?g|png|svg|webp|mp4|mov|mkv|webm|mp3|wav|m4a|ogg|html?|css|jsx?|tsx?)$"


def artifact_category(name: Column, preview: Column | None = None, url: Column | None = None, local: Column | None = None, chat: Column | None = None) -> Column:
    """work, document, skill, link or chatText: what the preview or name says, then a local file, an address, or chat text; else a work.

    A null name is empty; a null or blank preview or url says nothing.
    """
    name = F.trim(F.coalesce(name, F.lit("")))
    kind = F.lower(F.trim(F.coalesce(F.lit("") if preview is None else preview, F.lit(""))))
    said = lambda c: F.coalesce(F.lit(False) if c is None else c, F.lit(False))
    linked = F.lit(False) if url is None else F.coalesce(F.trim(url) != "", F.lit(False))
    return (
        F.when((kind == "skill") | name.rlike(SKILL), "skill").when(kind.isin(*DOCUMENT_PREVIEWS) | name.rlike(DOCUMENT), "document")
        .when(kind.isin(*WORK_PREVIEWS) | name.rlike(WORK) | said(local), "work").when(linked, "link").when(said(chat), "chatText").otherwise("work")
    )


def artifact_scope(df: DataFrame, tab: str | None = None, conv: str | None = None, q: str | None = None, library: bool = False) -> DataFrame:
    df = df.filter("verified")
    if library:
        df = df.filter("library_ready")
    if tab:
        df = df.filter(F.col("category") == tab)
    if conv:
        df = df.filter(F.col("conv_id") == conv)
    if q:
        hit = F.lit(False)
        for c in ("name", "text", "sender", "url"):
            hit = hit | F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
        df = df.filter(hit)
    return df


def artifact_counts(df: DataFrame, categories: tuple[str, ...] = ("work", "document", "skill", "link", "chatText")) -> DataFrame:
    """Artifacts by category, and all of them but chat texts."""
    return df.agg(F.count_if(F.col("category") != "chatText").alias("all"), *[F.count_if(F.col("category") == c).alias(c) for c in categories])


def split_assets(records: DataFrame) -> dict[str, DataFrame]:
    """One record per asset to five tables; a link that is not exact, confirmed and identified is quarantined with all its candidates.

    records: asset_id, source_key, conv_id, verdict, confirmed, message_uid, candidates (array), state, reason, name.
    """
    ok = (F.col("verdict") == "exact") & F.col("confirmed") & F.col("message_uid").isNotNull()
    status = F.when(ok, "confirmed").otherwise("quarantined")
    return {
        "asset_sources": records.select("asset_id", "source_key", "conv_id"), "assets": records.select("asset_id", "name", status.alias("status")),
        "asset_associations": records.select("asset_id", status.alias("status"), F.when(ok, F.col("message_uid")).alias("message_uid"), "verdict"),
        "asset_candidates": records.select("asset_id", F.posexplode("candidates").alias("position", "candidate_uid")), "asset_materializations": records.select("asset_id", "state", "reason"),
    }


def artifacts_view(assets: DataFrame, links: DataFrame, sources: DataFrame, states: DataFrame, candidates: DataFrame) -> DataFrame:
    c = candidates.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "candidate_uid"))), lambda x: x["candidate_uid"]).alias("candidates"))
    return assets.join(links.drop("status"), "asset_id").join(sources, "asset_id").join(states, "asset_id").join(c, "asset_id", "left")


def asset_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of a run's 17 counters.

    tables: asset_sources (source_key, source_kind), assets, asset_associations (source_key, verdict, status, confirmed), asset_candidates,
    asset_materializations (state). Alignments count distinct resources by verdict; ready states are those called ready.
    """
    n = F.count("*")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    sources, links = tables["asset_sources"], tables["asset_associations"]
    resource = links.join(sources.filter("source_kind = 'resource'").select("source_key").distinct(), "source_key")
    verdicts = {"exact": "exact_alignments", "partial": "partial_alignments", "missing": "missing_alignments", "conflict": "conflicting_alignments"}
    # Distinct (verdict, resource) pairs first: one shuffle on the pair instead of four distinct counts.
    pairs = resource.select("verdict", "source_key").distinct()
    parts = [
        sources.agg(n.alias("sources"), is_("source_kind", "resource").alias("resources"), is_("source_kind", "voice").alias("voice_attempts")),
        tables["assets"].agg(n.alias("assets")), tables["asset_candidates"].agg(n.alias("candidates")),
        links.agg(
            n.alias("associations"), is_("status", "quarantined").alias("quarantined"),
            F.count_if("confirmed").alias("confirmed_associations"), F.count_if(~F.col("confirmed")).alias("unconfirmed_associations")),
        pairs.agg(*[is_("verdict", v).alias(c) for v, c in verdicts.items()]),
        tables["asset_materializations"].agg(
            n.alias("materializations"), is_("state", "ready").alias("ready"), is_("state", "not_attempted").alias("not_attempted"),
            F.count_if(~F.col("state").isin("ready", "not_attempted")).alias("unavailable")),
    ]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def asset_state():
    """present, missing or failed, and whether the pair of state and reason is legal; over columns match, path, error."""
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("match").isin("exact", "filename_only") & F.col("path").isNotNull(), "present").otherwise("missing")
    return F.struct(state.alias("state"), F.when(state == "failed", F.col("error")).when(state == "missing", F.col("match")).alias("reason"))


def run_receipt(metrics: DataFrame) -> DataFrame:
    """receipt: the hash of the one row's fields as JSON with sorted keys."""
    return metrics.select(F.sha2(F.to_json(F.struct(*sorted(metrics.columns))), 256).alias("receipt"))


def packed_strings(df: DataFrame, least: int = 6) -> DataFrame:
    """(resource_id, packed binary) -> resource_id, valid, hashes, names: the strings that length-delimited fields hold.

    Fields are walked to any depth that parses; a blob that does not parse is marked and gives what it held as far as it went.
    Names have any length; an extension of letters and digits and no slash tell them from other strings.
    """

    def run(batches):
        import re

        import pyarrow as pa

        hexes, named = re.compile("(?<![0-9a-f])[0-9a-f]{32}(?![0-9a-f])", re.IGNORECASE), re.compile(r"^[^\x00-\x1f/\\]+\.[A-Za-z0-9]+$")

        def varint(b, i, end):
            n = s = 0
            while i < end and s < 70:
                n |= (b[i] & 127) << s
                s, i = s + 7, i + 1
                if b[i - 1] < 128:
                    return n, i
            return None, i

        def fields(b, i, end):
            """Spans of the length-delimited fields of b[i:end] as far as it parses, and whether that is to its end."""
            spans: list = []
            while i < end:
                tag, i = varint(b, i, end)
                if not tag:
                    return spans, False
                wire = tag & 7
                if wire == 0:
                    n, i = varint(b, i, end)
                    if n is None:
                        return spans, False
                elif wire in (1, 5):
                    i += 8 if wire == 1 else 4
                elif wire == 2:
                    n, i = varint(b, i, end)
                    if n is None or i + n > end:
                        return spans, False
                    spans.append((i, i + n))
                    i += n
                else:
                    return spans, False
                if i > end:
                    return spans, False
            return spans, True

        def strings(b, spans):
            """The strings of spans and of the fields in them; a list of open spans and no recursion, which a deep blob would exhaust."""
            view = memoryview(b)
            while spans:
                i, end = spans.pop()
                if end - i > 1:
                    inner, whole = fields(b, i, end)
                    if whole:
                        spans += inner
                try:
                    yield str(view[i:end], "utf-8")
                except UnicodeDecodeError:
                    pass

        for batch in batches:
            valid, hashes, names = [], [], []
            for blob in batch.column(1).to_pylist():
                blob = blob or b""
                spans, whole = fields(blob, 0, len(blob))
                valid.append(blob != b"" and whole)
                held, called = set(), set()
                for s in strings(blob, spans):
                    held.update(hexes.findall(s))
                    if len(s) >= least and named.match(s):
                        called.add(s)
                hashes.append(sorted({h.lower() for h in held}))
                names.append(sorted(called))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(valid), pa.array(hashes, pa.list_(pa.string())), pa.array(names, pa.list_(pa.string()))], names=["resource_id", "valid", "hashes", "names"])

    kind = df.schema["resource_id"].dataType.simpleString()
    return df.select("resource_id", "packed").mapInArrow(run, f"resource_id {kind}, valid boolean, hashes array<string>, names array<string>")
