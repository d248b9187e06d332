"""The five calls over many boards at once: ingest, context, answer, diff, diagnose."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.functions import validate
from boardlens.operators import diff, graph, phases, refine, retrieve, spatial, tree
from boardlens.plans import models
from boardlens.plans.workers import ensure_importable
from boardlens.sources.scratch import materialise
from boardlens.sources.snapshots import SCHEMA_VERSION, BoardCache, SnapshotStore

PROMPT_CHARS, PROMPT_LEAST = 24_000, 4_096
VISION_BUDGET_S, VISION_SLOT_S, VISION_WORKERS = 35.0, 10.0, 3
#: cluster facts (a dict with cluster_id, inventory, node ids to picture) to a reply; raises to fall back.
Provider = Callable[[dict], dict]
REFINED = ["board_id", "cluster_ord", "cluster_id", "node_ids", "bounding_box", "label", "summary", "confirmed_node_ids", "summary_source", "model_id", "content_hash"]


class BoardEngine:
    def __init__(self, spark: SparkSession, root: str, *, config: models.ModelConfig | None = None, provider: Provider | None = None, cached_boards: int = 10):
        ensure_importable(spark)
        self.spark, self.store = spark, SnapshotStore(spark, root)
        self.config, self.provider = config or models.ModelConfig(), provider
        self.memory = BoardCache(cached_boards)

    # ---- ingest -------------------------------------------------------------------------------

    def ingest(self, docs: DataFrame, *, hint: str = "freeform", custom_phases: list[str] | None = None, mode: str = "balanced", force: bool = False, gap: float | None = None, adaptive: bool = True, max_size: int = spatial.MAX_CLUSTER, now_ms: int | None = None) -> DataFrame:
        """Documents (board_id, VARIANT doc) into snapshots; a row per board: snapshot_id, cached, counts, summary."""
        validate.choice("hint", hint, validate.HINTS)
        validate.choice("mode", mode, validate.MODES)
        custom = validate.custom_phases(custom_phases) if custom_phases else None
        nodes = materialise(tree.flatten_documents(docs), "ingest-nodes")
        stamp = docs.select("board_id", F.coalesce(F.expr("try_variant_get(doc, '$.lastModified', 'string')"), F.lit("unknown")).alias("modified"))
        keys = refine.node_hash(nodes).join(stamp, "board_id")
        what = F.struct("board_id", "modified", "node_hash", F.lit(hint), F.array(*[F.lit(p) for p in custom or []]).cast("array<string>"), F.lit(mode), F.lit(SCHEMA_VERSION), F.lit(self.config.signature()))
        keys = materialise(keys.withColumn("snapshot_id", F.sha2(F.to_json(what), 256)), "ingest-keys")
        known = self.store.headers().where(F.col("schema_version") == SCHEMA_VERSION).select("board_id", "snapshot_id").distinct()
        hits = keys.join(known, ["board_id", "snapshot_id"], "left_semi") if not force else keys.limit(0)
        todo = keys.join(hits.select("board_id"), "board_id", "left_anti")
        created = int(time.time() * 1000) if now_ms is None else now_ms

        new = nodes.join(todo.select("board_id", "snapshot_id"), "board_id")
        clusters = materialise(spatial.cluster(tree.clusterable_leaves(new).drop("snapshot_id"), gap=gap, adaptive=adaptive, max_size=max_size), "ingest-clusters")
        refined = materialise(self._refine(clusters, new.drop("snapshot_id"), mode, force), "ingest-refined")
        named = phases.map_phases(refined, hint, custom).withColumn("created_at_ms", F.lit(created).cast("long"))
        edges = graph.connector_edges(new)
        relations = graph.cluster_relations(edges, clusters)
        stamped = lambda df: df.join(todo.select("board_id", "snapshot_id"), "board_id") if "snapshot_id" not in df.columns else df
        for name, rows in (("nodes", new), ("edges", edges), ("clusters", named.drop("reused", "fell_back")), ("relations", relations)):
            self.store.write(name, stamped(rows))
        header = keys.select("board_id", "snapshot_id", "node_hash", F.lit(created).cast("long").alias("created_at_ms"), F.lit(hint).alias("doc_structure_hint"), F.lit(mode).alias("ingest_mode"), F.array(*[F.lit(p) for p in custom or []]).cast("array<string>").alias("custom_phases"))
        self.store.append_headers(header)
        self.store.collect_garbage()
        return self._report(keys, hits, named, hint)

    def _refine(self, clusters: DataFrame, nodes: DataFrame, mode: str, force: bool) -> DataFrame:
        rows = materialise(refine.members(clusters, nodes), "ingest-members")
        facts = materialise(refine.cluster_facts(rows), "ingest-facts")
        hashed = clusters.join(refine.content_hash(rows, "board_id", "cluster_id").drop("n_members"), ["board_id", "cluster_id"])
        old = None if force else self.store.read("clusters", self.store.latest())
        if old is None:
            index = self.spark.createDataFrame([], "board_id string, content_hash string, previous struct<label:string,summary:string,summary_source:string,model_id:string,confirmed_node_ids:array<string>>")
        else:
            index = refine.reuse_index(old, self.store.read("nodes", self.store.latest()))
        routed = materialise(refine.reuse(hashed, facts, index, mode), "ingest-routed")
        base = clusters.select("board_id", "cluster_id", "cluster_ord", "node_ids", "bounding_box").join(routed.select("board_id", "cluster_id", "content_hash", "previous", "due"), ["board_id", "cluster_id"])
        texted = refine.deterministic(facts).select("board_id", "cluster_id", F.col("label").alias("t_label"), F.col("summary").alias("t_summary"))
        base = base.join(texted, ["board_id", "cluster_id"])
        replies = self._ask(base.where(F.col("previous").isNull() & F.col("due")), facts, rows) if self.provider else None
        if replies is None:
            base = base.withColumn("reply", F.lit(None).cast("struct<label:string,summary:string,model_id:string,confirmed:array<string>,listed:array<string>,ok:boolean>"))
        else:
            base = base.join(replies, ["board_id", "cluster_id"], "left")
        p, r = (lambda c: F.col(f"previous.{c}")), (lambda c: F.col(f"reply.{c}"))
        seen = F.coalesce(r("ok"), F.lit(False))
        pick = lambda prev, rep, det: F.when(F.col("previous").isNotNull(), prev).when(seen, rep).otherwise(det)
        return base.select(
            "board_id", "cluster_ord", "cluster_id", "node_ids", "bounding_box",
            pick(p("label"), r("label"), F.col("t_label")).alias("label"),
            pick(p("summary"), r("summary"), F.col("t_summary")).alias("summary"),
            pick(refine.carried_ids(F.col("node_ids"), p("confirmed_node_ids")), refine.merge_reply(F.col("node_ids"), r("confirmed"), r("listed")), F.col("node_ids")).alias("confirmed_node_ids"),
            pick(p("summary_source"), F.lit("vision_llm"), F.lit("deterministic")).alias("summary_source"),
            pick(p("model_id"), r("model_id"), F.lit(None).cast("string")).alias("model_id"),
            "content_hash", F.col("previous").isNotNull().alias("reused"), (F.col("reply").isNotNull() & ~seen).alias("fell_back"),
        )

    def _ask(self, due: DataFrame, facts: DataFrame, rows: DataFrame) -> DataFrame:
        """Replies of the provider in order of priority, within a budget a task; a failure falls back to text."""
        provider, on = self.provider, ["board_id", "cluster_id"]
        queue = refine.vision_queue(facts).select(*on, "queue")
        shots = refine.screenshot_nodes(rows).groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("shot", "id"))), lambda s: s["id"]).alias("shots"))
        listed = refine.inventory(rows).withColumnRenamed("text", "inventory")
        asked = due.select(*on, "node_ids").join(queue, on).join(shots, on).join(listed, on).repartition(VISION_WORKERS, *on).sortWithinPartitions("queue")

        def run(batches):
            import pandas as pd

            end = time.monotonic() + VISION_BUDGET_S
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    reply = None
                    if end - time.monotonic() >= VISION_SLOT_S:
                        try:
                            reply = provider({k: list(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v for k, v in row.items()})
                        except Exception:  # any failure falls back to text rules, and is counted
                            reply = None
                    label, summary = ((reply or {}).get(k) for k in ("label", "summary"))
                    label, summary = (v.strip() if isinstance(v, str) else "" for v in (label, summary))
                    confirmed = (reply or {}).get("confirmedNodeIds")
                    confirmed = [i for i in confirmed if isinstance(i, str)] if isinstance(confirmed, list) else []
                    out.append((row["board_id"], row["cluster_id"], {"label": label, "summary": summary, "model_id": (reply or {}).get("modelId"), "confirmed": confirmed, "listed": list(row["listed"]), "ok": bool(label and summary)}))
                yield pd.DataFrame(out, columns=["board_id", "cluster_id", "reply"])

        return materialise(asked.mapInPandas(run, "board_id string, cluster_id string, reply struct<label:string,summary:string,model_id:string,confirmed:array<string>,listed:array<string>,ok:boolean>"), "replies")

    def _report(self, keys: DataFrame, hits: DataFrame, named: DataFrame, hint: str) -> DataFrame:
        extra = named.groupBy("board_id").agg(F.count_if("reused").alias("reused"), F.count_if("fell_back").alias("fallbacks"))
        fresh = refine.quality_report(named).join(extra, "board_id")
        kept = self.store.read("clusters", hits)
        stored = refine.quality_report(kept.withColumn("summary_source", F.lit("cache"))).withColumns({"reused": F.lit(0).cast("long"), "fallbacks": F.lit(0).cast("long")})
        report = materialise(fresh.unionByName(stored), "ingest-report")
        return keys.select("board_id", "snapshot_id").join(report, "board_id", "left").join(refine.ingest_summary(report, hint), "board_id", "left")

    # ---- reading ------------------------------------------------------------------------------

    def board(self, board_id: str) -> dict[str, DataFrame]:
        """The latest snapshot's tables; from memory first, else restored with the source ``cache``."""
        held = self.memory.get(board_id)
        if held is None:
            keys = self.store.latest().where(F.col("board_id") == board_id)
            key = keys.first()
            if key is None:
                raise LookupError(f"board {board_id} has not been ingested")
            held = {n: self.store.read(n).where((F.col("board_id") == board_id) & (F.col("snapshot_id") == key["snapshot_id"])) for n in ("nodes", "edges", "clusters", "relations")}
            held["clusters"] = held["clusters"].withColumn("summary_source", F.lit("cache"))
            self.memory.put(board_id, held)
        return held

    def context(self, board_id: str, topic: str | None = None) -> DataFrame:
        b = self.board(validate.board_key(board_id))
        return retrieve.context_text(b["clusters"], b["relations"], validate.topic(topic) if topic else None)

    def answer(self, board_id: str, question: str, *, call: Callable[[str, str], object] | None = None, max_chars: int = PROMPT_CHARS) -> dict:
        """{answer, cited, context}: a model's answer over the rendered context, or extracted sentences without a model."""
        question, b = validate.question(question), self.board(board_id)
        found = materialise(retrieve.retrieve(b["clusters"], b["relations"], question), "answer")
        budget = max(PROMPT_LEAST, max_chars) - len(question)
        if budget < 1:
            raise ValueError("the question leaves no room for the board")
        extract = retrieve.extractive_answer(b["clusters"], question).first()
        rendered = retrieve.render_context(found, b["relations"], budget).first()
        text = rendered["text"] if rendered else ""
        if call and not retrieve.no_match(b["clusters"], found).first()["no_match"]:
            try:
                reply = call(question, text)
            except models.ModelFailed:
                reply = None
            if isinstance(reply, dict) and isinstance(reply.get("answer"), str):
                known = {}
                for r in found.where(F.col("cluster_id").isin(*rendered["included"])).orderBy("place").select("label").collect():
                    known[r["label"].lower()] = r["label"]
                cited = dict.fromkeys(known[c.lower()] for c in reply.get("citedClusters", []) if isinstance(c, str) and c.lower() in known)
                return {"answer": reply["answer"], "cited": list(cited), "context": text}
        return {"answer": extract["answer"], "cited": extract["cited"], "context": text}

    def diff(self, board_id: str, compare_to: int = 1) -> dict:
        """What changed since ``compare_to`` snapshots ago: counts, rows and text."""
        steps = validate.compare_to(compare_to)
        h = self.store.history([board_id]).orderBy(F.desc("seq")).collect()  # at most the history's cap
        if not h:
            raise LookupError(f"board {board_id} has no history")
        if len(h) <= steps:
            raise LookupError(f"board {board_id} has {len(h)} snapshots; none is {steps} before the latest")
        side = {}
        for name, e in (("after", h[0]), ("before", h[steps])):
            side[name] = {t: self.store.read(t).where((F.col("board_id") == board_id) & (F.col("snapshot_id") == e["snapshot_id"])) for t in ("nodes", "edges", "clusters")}
            if not side[name]["nodes"].limit(1).count():
                raise LookupError(f"a snapshot of board {board_id} is missing")
        a, b = side["after"], side["before"]
        nodes = materialise(diff.node_changes(b["nodes"], a["nodes"]), "diff-nodes")
        clusters = materialise(diff.cluster_changes(b["clusters"], a["clusters"], b["nodes"], a["nodes"]), "diff-clusters")
        changes = diff.connection_changes(b["edges"], a["edges"])
        both = a["clusters"].unionByName(b["clusters"].join(a["clusters"].select("cluster_id"), "cluster_id", "left_anti"))
        all_nodes = a["nodes"].unionByName(b["nodes"].join(a["nodes"].select("id"), "id", "left_anti"))
        connections = materialise(diff.endpoint_labels(changes, both, all_nodes), "diff-edges")
        row = diff.statistics(nodes, clusters, connections).first()
        names = ("added_nodes", "removed_nodes", "edited_nodes", "new_clusters", "removed_clusters", "modified_clusters", "unchanged_clusters", "added_connections", "removed_connections")
        stats = {n: int(row[n]) if row else 0 for n in names}
        iso = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        text = diff.report(board_id, (iso(h[steps]["created_at_ms"]), iso(h[0]["created_at_ms"])), stats, clusters.orderBy("cluster_ord").collect(), connections.orderBy("first_ord").collect())
        return {"stats": stats, "text": text, "nodes": nodes, "clusters": clusters, "connections": connections}

    def diagnose(self, call: Callable[[str, object, str | None], str]) -> DataFrame:
        return models.diagnose(self.spark, self.config, call)


def parse_documents(raw: DataFrame) -> DataFrame:
    """(board_id, raw JSON text) to (board_id, VARIANT doc); text that is no JSON is an error."""
    return raw.select("board_id", F.parse_json(T.utrim(F.col("raw"))).alias("doc"))
