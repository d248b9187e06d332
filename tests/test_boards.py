"""Operators against worked fixtures and against sequential restatements of their rules."""

from __future__ import annotations

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.functions import validate
from boardlens.operators import components, diff, graph, history, phases, refine, retrieve, spatial, tree

NODE = "board_id string, ord long, id string, name string, type string, x double, y double, width double, height double, rotation double, image_ref string, text string, parent_id string, connector_start_id string, connector_end_id string"


def node(i, id, x=0.0, y=0.0, w=200.0, h=100.0, rot=0.0, kind="STICKY", text=None, image=None, parent=None, ends=(None, None), board="b", name="Sticky"):
    return (board, i, id, name, kind, float(x), float(y), float(w), float(h), float(rot), image, text, parent, *ends)


def nodes_df(spark, rows):
    return spark.createDataFrame(rows, NODE)


def groups(df):
    return sorted(sorted(r["node_ids"]) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


class TestText:
    @pytest.mark.parametrize(("raw", "want"), [(" \ta\n", "a"), ("  x　", "x"), ("﻿x", "x"), ("\x85x", "\x85x"), ("", ""), ("   ", "")])
    def test_trim_strips_unicode_space(self, spark, raw, want):
        assert one(spark, T.utrim(F.lit(raw))) == want

    def test_truncations(self, spark):
        assert one(spark, T.cut_dots(F.lit("abcdefgh"), 6)) == "abc..."
        assert one(spark, T.cut_ellipsis(F.lit("abcdefgh"), 6)) == "abcde…"
        assert one(spark, T.cut_append(F.lit("abcdefgh"), 6)) == "abcdef…"
        assert [one(spark, T.cut_to(F.lit("ab cd"), F.lit(n))) for n in (0, 1, 4, 5)] == ["", "…", "ab…", "ab cd"]

    def test_labels_sentences_lists(self, spark):
        assert one(spark, T.compact_label(F.lit('"one  two\nthree four five six seven'))) == "one two three four five six"
        assert one(spark, T.first_sentence(F.lit("A b. C d! E"))) == "A b."
        assert one(spark, T.format_list(F.array(*[F.lit(x) for x in "abac"]), F.lit(False))) == "a, b and c"
        assert one(spark, T.format_list(F.array(F.lit("a"), F.lit("b")), F.lit(True))) == "a und b"
        assert one(spark, T.escape_markup(F.lit("<a>&amp;"))) == "&lt;a&gt;&amp;amp;"

    def test_questions(self, spark):
        assert one(spark, T.significant_words(F.lit("Which banana and BANANA findings matter?"))) == ["which", "banana", "banana", "findings", "matter"]
        assert one(spark, T.is_german(F.lit("Worum geht es im Projekt?"))) is True
        assert one(spark, T.is_german(F.lit("What was the outcome?"))) is False
        assert [one(spark, T.is_overview(F.lit(q))) for q in ("Überblick bitte", "How do the parts relate?", "What was the main pain point?")] == [True, True, False]

    def test_replies(self, spark):
        for raw in ('```json\n{"a": 1}\n```', 'text {"a": 1} more', '{"a": 1}'):
            assert one(spark, F.expr("1") * F.variant_get(T.parse_json_reply(F.lit(raw)), "$.a", "int")) == 1
        assert one(spark, T.parse_json_reply(F.lit("none")).isNull()) is True

    @pytest.mark.parametrize(("ms", "want"), [(-1, "1969-12-31T23:59:59Z"), (253402300799999, "9999-12-31T23:59:59Z"), (253402300800000, "10000-01-01T00:00:00Z"), (8640000000000000, "275760-09-13T00:00:00Z")])
    def test_times_have_no_sign(self, spark, ms, want):
        assert one(spark, T.iso_seconds(F.lit(ms))) == want

    @pytest.mark.parametrize(("url", "key"), [
        ("https://www.boards.example/board/AbC123XyZ456/name", "AbC123XyZ456"), ("https://boards.example/file/AbC123XyZ456/", "AbC123XyZ456"),
        ("http://boards.example/file/AbC123XyZ456", None), ("https://boards.example:8443/file/AbC123XyZ456", None), ("https://me:pw@boards.example/file/AbC123XyZ456", None),
        ("https://evil.example/boards.example/file/AbC123XyZ456", None), ("https://notboards.example/file/AbC123XyZ456", None), ("https://boards.example.evil.org/file/AbC123XyZ456", None),
        ("https://boards.example/other/AbC123XyZ456", None), ("https://boards.example/file/AbC123XyZ456/a/b", None), ("https://boards.example/file/abc", None), ("https://boards.example/file/abc-def-ghi", None), ("nonsense", None),
    ])
    def test_file_keys(self, spark, url, key):
        assert one(spark, T.file_key(F.lit(url), "boards.example")) == key


class TestValidation:
    @pytest.mark.parametrize("bad", [[], [" "], ["x" * 81], ["Ideen", "IDEEN"], ["A", "Ａ"], list("abcdefghijklm")])
    def test_phases(self, bad):
        with pytest.raises(ValueError):
            validate.custom_phases(bad)

    @pytest.mark.parametrize("bad", ["short", "abc-def", "abc/def", "a" * 129])
    def test_keys(self, bad):
        with pytest.raises(ValueError):
            validate.board_key(bad)

    def test_lengths_and_settings(self, monkeypatch):
        for f, n in ((validate.question, 2001), (validate.topic, 201)):
            with pytest.raises(ValueError):
                f("x" * n)
            with pytest.raises(ValueError):
                f("  ")
        monkeypatch.setenv("N", "7")
        assert validate.read_int("N", 3, 1) == 7 and validate.read_int("N", 3, 8) == 3
        monkeypatch.setenv("B", "off")
        assert validate.read_bool("B", True) is False and validate.read_bool("MISSING", True) is True


class TestTree:
    def test_fixture(self, spark):
        from boardlens.plans.catalogue import flatten_one_document

        rows = flatten_one_document(spark).orderBy("ord").collect()
        assert [r["id"] for r in rows] == ["0:1", "1:2", "1:3", "1:4", "1:5", "1:6", "1:10"]
        by = {r["id"]: r for r in rows}
        assert by["1:4"]["parent_id"] == "1:3" and by["1:5"]["rotation"] == 45 and by["1:6"]["image_ref"] == "img-ref-abc123" and by["0:1"]["parent_id"] == "0:0" and by["1:2"]["text"] == "Hello"

    def test_no_root_is_an_error(self, spark):
        docs = spark.createDataFrame([("b", "{}")], "board_id string, raw string").select("board_id", F.parse_json("raw").alias("doc"))
        with pytest.raises(ValueError):
            tree.flatten_documents(docs)

    def test_leaves(self, spark):
        rows = [node(0, "p", kind="GROUP"), node(1, "a", parent="p"), node(2, "c", kind="CONNECTOR"), node(3, "z", w=0, h=0)]
        assert [r["id"] for r in tree.clusterable_leaves(nodes_df(spark, rows)).collect()] == ["a"]


class TestSpatial:
    def test_two_groups(self, spark):
        rows = [node(i, n, x, y) for i, (n, x, y) in enumerate([("a1", 0, 0), ("a2", 220, 0), ("a3", 0, 120), ("b1", 2000, 1500), ("b2", 2220, 1500)])]
        assert groups(spatial.cluster(nodes_df(spark, rows))) == [["a1", "a2", "a3"], ["b1", "b2"]]

    def test_empty(self, spark):
        assert spatial.cluster(nodes_df(spark, [])).count() == 0

    def test_rotated_and_threshold(self, spark):
        rows = [node(0, "a1"), node(1, "a2", 220), node(2, "r1", 460, 0, 140, 140, 45), node(3, "b1", 2000, 1500)]
        assert groups(spatial.cluster(nodes_df(spark, rows))) == [["a1", "a2", "r1"], ["b1"]]
        two = nodes_df(spark, [node(0, "n1"), node(1, "n2", 500)])
        assert len(groups(spatial.cluster(two, gap=100))) == 2 and len(groups(spatial.cluster(two, gap=400))) == 1

    def test_thin_box_beside_a_rotated_one(self, spark):
        rows = [node(0, "r", -50, -50, 100, 100, 30), node(1, "t", 307, -200, 10, 400)]
        assert len(groups(spatial.cluster(nodes_df(spark, rows), gap=160))) == 1

    def test_overflow(self, spark):
        rows = [node(0, "large", 0, 0, 1000, 1000), node(1, "near", 1100, 0, 100, 100), node(2, "far", 5000, 0, 100, 100)]
        assert groups(spatial.cluster(nodes_df(spark, rows), gap=160, max_cells=4)) == [["far"], ["large", "near"]]

    @pytest.mark.parametrize("most", [1, 6, 4096])
    def test_pairs_of_all_sizes_equal_brute_force(self, spark, most):
        draw = random.Random(most)
        size = lambda: 10 ** draw.uniform(0, 7)
        far = lambda: draw.choice((-1, 1)) * 10 ** draw.uniform(1, 7)
        rows = [node(i, f"n{i}", far(), far(), size(), size(), 30 if board == "q" and draw.random() < 0.2 else 0, board=board) for board in "pq" for i in range(120)]

        def gap(a, b):
            (ax, ay, aw, ah, ar), (bx, by, bw, bh, br) = a[5:10], b[5:10]
            if ar or br:
                return max(0, math.hypot(ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2) - (aw + ah) / 4 - (bw + bh) / 4)
            return math.hypot(max(0, ax - bx - bw, bx - ax - aw), max(0, ay - by - bh, by - ay - ah))

        want = sorted((a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and gap(a, b) <= 160)
        assert sorted(tuple(r) for r in spatial.near_pairs(nodes_df(spark, rows), gap=160, max_cells=most).collect()) == want

    def test_many_nodes_over_few_cells(self, spark):
        k = F.col("id")
        nodes = spark.range(40_000).select(
            F.lit("b").alias("board_id"), k.alias("ord"), k, (k % 200 * 500).cast("double").alias("x"), (F.floor(k / 200) * 1000).cast("double").alias("y"),
            F.lit(400.0).alias("width"), F.lit(300.0).alias("height"), F.lit(0.0).alias("rotation"),
        )
        began = time.monotonic()
        got = spatial.near_pairs(nodes, gap=160, max_cells=6).agg(F.count("*"), F.sum(F.col("b") - F.col("a"))).first()
        assert tuple(got) == (200 * 199, 200 * 199) and time.monotonic() - began < 40

    def test_bisect_and_numbers(self, spark):
        rows = [node(i, f"n{i}", 50 * i, 0, 100, 100) for i in range(11)]
        got = spatial.cluster(nodes_df(spark, rows), gap=0, max_size=4)
        assert sorted(len(g) for g in groups(got)) == [2, 3, 3, 3] and sum(len(g) for g in groups(got)) == 11
        rows = [node(0, "late", 1000, 900, 100, 50), node(1, "early1", 0, 0, 100, 50), node(2, "early2", 120, 40, 100, 50)]
        first = spatial.cluster(nodes_df(spark, rows)).orderBy("cluster_ord").first()
        assert first["cluster_id"] == "cluster_1" and first["node_ids"] == ["early1", "early2"] and tuple(first["bounding_box"]) == (0, 0, 220, 90)

    def test_adaptive(self, spark):
        rows = [node(i, f"n{i}", 530 * g + 140 * c, 100 * r, 120, 80) for i, (g, c, r) in enumerate((g, c, r) for g in range(3) for c in range(3) for r in range(2))]
        df = nodes_df(spark, rows)
        assert len(groups(spatial.cluster(df))) == 1 and len(groups(spatial.cluster(df, adaptive=True))) == 3

    @pytest.mark.parametrize("bad", [{"w": -1}, {"x": math.inf}])
    def test_bad_geometry(self, spark, bad):
        with pytest.raises(Exception, match="invalid geometry"):
            spatial.cluster(nodes_df(spark, [node(0, "a", **bad)]))

    def test_bad_options(self, spark):
        with pytest.raises(ValueError):
            spatial.cluster(nodes_df(spark, [node(0, "a")]), max_size=0)
        with pytest.raises(ValueError):
            spatial.cluster(nodes_df(spark, [node(0, "a")]), gap=-1)

    def test_random_board_equals_brute_force(self, spark):
        seed = 42

        def draw():
            nonlocal seed
            seed = (seed * 1664525 + 1013904223) % 2**32
            return seed / 2**32

        rows = [node(i, f"n{i}", *[f() for f in (lambda: draw() * 4000, lambda: draw() * 3000, lambda: 60 + draw() * 180, lambda: 60 + draw() * 120, lambda: 30 if draw() < 0.2 else 0)]) for i in range(140)]

        def gap(a, b):
            ax, ay, aw, ah, ar = a[5:10]
            bx, by, bw, bh, br = b[5:10]
            if ar or br:
                return max(0, math.hypot(ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2) - (aw + ah) / 4 - (bw + bh) / 4)
            return math.hypot(max(0, ax - bx - bw, bx - ax - aw), max(0, ay - by - bh, by - ay - ah))

        parent = list(range(140))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        want = set()
        for i in range(140):
            for j in range(i):
                if gap(rows[i], rows[j]) <= 160:
                    want.add((f"n{j}", f"n{i}"))
                    parent[find(i)] = find(j)
        df = nodes_df(spark, rows)
        assert {(r["a"], r["b"]) for r in spatial.near_pairs(df, gap=160).collect()} == want
        parts = {}
        for i in range(140):
            parts.setdefault(find(i), []).append(f"n{i}")
        assert groups(spatial.cluster(df, gap=160)) == sorted(sorted(p) for p in parts.values())

    def test_components_of_a_chain(self, spark):
        edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
        got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
        assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def clusters_df(spark, rows):
    return spark.createDataFrame([("b", i + 1, f"cluster_{i + 1}", ids, label, summary, phase) for i, (ids, label, summary, phase) in enumerate(rows)], "board_id string, cluster_ord int, cluster_id string, node_ids array<string>, label string, summary string, phase string")


class TestGraph:
    def test_edges(self, spark):
        c = lambda i, ends, text=None: node(i, f"c{i}", kind="CONNECTOR", ends=ends, text=text)
        rows = [c(1, ("a", "b"), "leads to"), c(2, ("a", None)), c(3, (None, "b")), c(4, ("a", "b"), "  "), c(5, ("a", ""))]
        got = [(r["connector_id"], r["label"]) for r in graph.connector_edges(nodes_df(spark, rows)).orderBy("ord").collect()]
        assert got == [("c1", "leads to"), ("c4", None)]

    def test_relations_and_lines(self, spark):
        c = clusters_df(spark, [(["a", "b"], "Research", "", None), (["c"], "Ideas", "", None)])
        e = spark.createDataFrame([("b", 0, "a", "c", "zzz"), ("b", 1, "b", "c", "informs"), ("b", 2, "b", "c", None), ("b", 3, "a", "b", "x"), ("b", 4, "a", "gone", "y"), ("b", 5, "a", "c", "informs")], "board_id string, ord long, from_node_id string, to_node_id string, label string")
        r = graph.cluster_relations(e, c)
        row = r.collect()
        assert len(row) == 1 and row[0]["labels"] == ["zzz", "informs"] and row[0]["edge_count"] == 4
        assert [x["line"] for x in graph.relation_lines(r, c).collect()] == ['- "Research" → "Ideas" — "zzz", "informs" (4 connectors)']


class TestPhases:
    @pytest.mark.parametrize(("label", "summary", "hint", "custom", "want"), [
        ("Notes", "Random notes.", "freeform", None, None),
        ("User interviews", "Quotes and research insights from users.", "double_diamond", None, "discover"),
        ("Went well", "Shipping the beta went well, kudos to the team.", "retro", None, "went_well"),
        ("Verbessern", "Deployment war ein Blocker, das müssen wir verbessern.", "retro", None, "needs_improvement"),
        ("Next steps", "Action items with owners for the next sprint.", "retro", None, "action_items"),
        ("Ideen sammeln", "Erste Ideen für das Feature.", "freeform", ["Ideen", "Offene Fragen"], "Ideen"),
        ("Random", "Nothing that matches a phase name.", "freeform", ["Ideen", "Offene Fragen"], "unclear"),
        ("Mixed", "One idea and one interview.", "double_diamond", None, "unclear"),
    ])
    def test_fixtures(self, spark, label, summary, hint, custom, want):
        c = clusters_df(spark, [([], label, summary, None)]).drop("phase")
        assert phases.map_phases(c, hint, custom).first()["phase"] == want


class TestRetrieval:
    def base(self, spark):
        return clusters_df(spark, [(["a"], "User research", "The project investigates student planning problems and user pain points.", None), (["b"], "Prototype concept", "The team sketches a calendar assistant prototype for semester projects.", None)])

    def relations(self, spark, rows):
        return spark.createDataFrame(rows, "board_id string, from_cluster_id string, to_cluster_id string, labels array<string>, edge_count int, first_ord long")

    def test_answers(self, spark):
        a = retrieve.extractive_answer(self.base(spark), "Worum geht es im Projekt?").first()
        assert a["answer"].startswith("Aus dem Board geht hervor") and a["cited"] == ["User research", "Prototype concept"]
        a = retrieve.extractive_answer(self.base(spark), "What was the main pain point?").first()
        assert a["answer"].startswith("Based on the board, the project is mainly about User research. The project investigates")
        a = retrieve.extractive_answer(self.base(spark), "Where is the quantum reactor documented?").first()
        assert a["answer"] == "The answer is not supported by the cached board context." and a["cited"] == []

    def test_top_six_in_board_order(self, spark):
        c = clusters_df(spark, [([], f"C{i}", "banana", None) for i in range(7)] + [([], "other", "none", None)])
        got = retrieve.primaries(c, "Which banana findings matter?").orderBy("place").collect()
        assert [r["label"] for r in got] == [f"C{i}" for i in range(6)]

    def test_neighbours_and_no_match(self, spark):
        c = clusters_df(spark, [([], "Payment findings", "payment failures", None), ([], "Roadmap", "plan", None), ([], "Marketing", "ads", None), ([], "Brand", "logo", None)])
        r = self.relations(spark, [("b", "cluster_1", "cluster_2", ["affects"], 1, 0), ("b", "cluster_3", "cluster_4", [], 1, 1)])
        found = retrieve.retrieve(c, r, "What do the payment failures affect?")
        assert [x["label"] for x in found.orderBy("place").collect()] == ["Payment findings", "Roadmap"]
        assert retrieve.no_match(c, found).first()["no_match"] is False
        assert retrieve.no_match(c, retrieve.retrieve(c, r, "quantum reactor")).first()["no_match"] is True

    def test_budget(self, spark):
        c = clusters_df(spark, [([], f"C{i}", "x" * 18_000, None) for i in range(30)])
        r = self.relations(spark, [("b", "cluster_1", "cluster_2", ["informs"], 2, 0)])
        out = retrieve.render_context(retrieve.retrieve(c, r, "overview please"), r, 24_000).first()
        assert len(out["text"]) <= 24_000 and len(out["included"]) == 30 and '"C0" → "C1"' in out["text"]

    def test_topic_and_escape(self, spark):
        c = clusters_df(spark, [([], "Interview quotes", "said", None), ([], "Other <b>", "x & y", "p")])
        r = self.relations(spark, [("b", "cluster_1", "cluster_2", [], 1, 0)])
        text = retrieve.context_text(c, r, "interview quotes").first()["context_text"]
        assert "1 of 2 clusters (topic: interview quotes)" in text and "Connections" not in text
        text = retrieve.context_text(c, r, "zebra").first()["context_text"]
        assert text.startswith('(No cluster specifically matched topic "zebra"') and "2 of 2 clusters:" in text and "Connections" in text
        out = retrieve.render_context(retrieve.retrieve(c, r, "summary"), r, 5000).first()["text"]
        assert "- Other &lt;b&gt; (p): x &amp; y" in out


class TestRefine:
    def rows(self, spark, specs):
        r = nodes_df(spark, [node(i, f"n{i:03d}", **s) for i, s in enumerate(specs)])
        return r.withColumns({"cluster_id": F.lit("cluster_3"), "pos": F.col("ord")})

    def test_text_rules(self, spark):
        f = refine.deterministic(refine.cluster_facts(self.rows(spark, [{"text": " "}, {"text": "Hello there"}, {"image": "i"}]))).first()
        assert f["label"] == "Hello there"
        assert f["summary"].startswith('Cluster contains 3 board elements with 1 extracted text item. Extracted text highlights: "Hello there". It includes 1 image element that')
        f = refine.deterministic(refine.cluster_facts(self.rows(spark, [{"name": "Rectangle 12"}, {"name": " My plan "}]))).first()
        assert f["label"] == "My plan" and "No readable text" in f["summary"]
        assert refine.deterministic(refine.cluster_facts(self.rows(spark, [{"name": "Sticky"}]))).first()["label"] == "Cluster 3"

    def test_inventory_budgets(self, spark):
        specs = [{"text": "t" * 920, "image": "i" if i % 10 == 0 else None} for i in range(500)]
        got = refine.inventory(self.rows(spark, specs)).first()
        assert len(got["listed"]) <= 160 and len(got["text"]) <= 24_000 and got["text"].endswith("retained automatically.]")
        assert got["listed"][0] == "n000" and "showing" in got["text"]
        small = refine.inventory(self.rows(spark, [{"text": 'a "q"'}, {}])).first()
        assert small["text"].split("\n")[0] == '- n000 (STICKY): "a \\"q\\""' and small["listed"] == ["n000", "n001"]

    def test_reply_merge(self, spark):
        arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
        assert one(spark, refine.merge_reply(arr("a", "b", "c"), arr("b", "zz"), arr("a", "b"))) == ["b", "c"]
        assert one(spark, refine.merge_reply(arr("a", "b"), arr("zz"), arr("a", "b"))) == ["a", "b"]
        assert one(spark, refine.carried_ids(arr("a", "b"), arr("b", "x"))) == ["b"]

    def test_reply_merge_equals_sets(self, spark):
        draw = random.Random(7)
        some = lambda most: None if draw.random() < 0.1 else [draw.choice("abcdefghij") for _ in range(draw.randrange(most))]
        cases = [([f"{n}" for n in draw.sample(range(10), draw.randrange(10))] if k % 2 else some(12) or [], some(8), some(8)) for k in range(120)]
        cases = [(k, ids, *([str("abcdefghij".index(i)) for i in c] if c and k % 2 else c for c in said)) for k, (ids, *said) in enumerate(cases)]
        rows = spark.createDataFrame(cases, "k int, ids array<string>, confirmed array<string>, listed array<string>")
        got = {r["k"]: r["m"] for r in rows.select("k", refine.merge_reply(F.col("ids"), F.col("confirmed"), F.col("listed")).alias("m")).collect()}
        for k, ids, confirmed, listed in cases:
            valid = set(confirmed or []) & set(ids) & set(listed or [])
            assert got[k] == ([i for i in ids if i in valid or i not in listed] if valid else ids)

    @pytest.mark.parametrize("repeat", [1, 2])
    def test_reply_merge_of_a_large_cluster(self, spark, repeat):
        n = 20_000
        ids = F.flatten(F.array_repeat(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), repeat))
        rows = spark.range(1).select(ids.alias("ids")).withColumns({"said": F.filter("ids", lambda i: i.cast("int") % 3 == 0), "listed": F.filter("ids", lambda i: i.cast("int") % 2 == 0)})
        began = time.monotonic()
        got = rows.select(refine.merge_reply(F.col("ids"), F.col("said"), F.col("listed")).alias("m")).first()["m"]
        assert time.monotonic() - began < 60
        assert got == [str(i) for i in range(1, n + 1) if i % 2 or i % 3 == 0] * repeat


class TestHistory:
    def h(self, spark, keys, board="b"):
        return spark.createDataFrame([(board, i, k) for i, k in enumerate(keys)], "board_id string, seq long, cache_key string")

    def test_append_and_cap(self, spark):
        assert [r["cache_key"] for r in history.append(self.h(spark, ["k1", "k2", "k2"])).orderBy("seq").collect()] == ["k1", "k2"]
        assert [r["cache_key"] for r in history.append(self.h(spark, ["a", "b", "a"])).orderBy("seq").collect()] == ["a", "b", "a"]
        got = [r["cache_key"] for r in history.append(self.h(spark, [f"k{i}" for i in range(25)])).orderBy("seq").collect()]
        assert got == [f"k{i}" for i in range(5, 25)]
        assert history.nth_back(self.h(spark, ["a", "b", "c"]), 1).first()["cache_key"] == "b"

    def test_garbage(self, spark):
        h = self.h(spark, [f"k{i}" for i in range(22)])
        owners = spark.createDataFrame([(f"k{i}", "b") for i in range(22)], "cache_key string, board_id string")
        pointer = spark.createDataFrame([("other", "k0", 3)], "board_id string, cache_key string, schema_version int")
        kept = history.append(h)
        gone = lambda o=owners, k=kept, p=pointer: [r["cache_key"] for r in history.collectable(history.dropped(h), o, k, p).collect()]
        assert gone() == ["k1"]
        assert gone(k=kept.unionByName(self.h(spark, ["k1"], "x"))) == []
        assert gone(k=kept.unionByName(self.h(spark, [None], "x"))) == []
        assert gone(o=owners.withColumn("board_id", F.lit("foreign"))) == []


class TestDiff:
    def board(self, spark, texts, members):
        n = nodes_df(spark, [node(i, k, text=t) for i, (k, t) in enumerate(texts.items())])
        return n, clusters_df(spark, [(ids, label, f"{label}. More.", None) for label, ids in members.items()])

    def test_main_case(self, spark):
        nb, cb = self.board(spark, {"a1": "Interview quotes", "a2": "Survey results", "b1": "Old plan", "c1": "Stable note"}, {"Research": ["a1", "a2"], "Old planning": ["b1"], "Stable": ["c1"]})
        na, ca = self.board(spark, {"a1": "Interview quotes", "a2": "Survey results!", "a3": "new", "c1": "Stable note", "d1": "x", "d2": "y"}, {"Research (extended)": ["a1", "a2", "a3"], "Stable": ["c1"], "Feedback": ["d1", "d2"]})
        n, c = diff.node_changes(nb, na), diff.cluster_changes(cb, ca, nb, na)
        none = diff.connection_changes(graph.connector_edges(nb), graph.connector_edges(na))
        s = diff.statistics(n, c, none).first()
        assert (s["added_nodes"], s["removed_nodes"], s["edited_nodes"]) == (3, 1, 1)
        assert (s["new_clusters"], s["removed_clusters"], s["modified_clusters"], s["unchanged_clusters"]) == (1, 1, 1, 1)
        m = c.where("change = 'modified'").first()
        assert (m["label"], m["previous_label"], m["added"], m["removed"], m["edited"]) == ("Research (extended)", "Research", 1, 0, 1)
        text = diff.report("b", ("t0", "t1"), s.asDict(), c.orderBy("cluster_ord").collect(), [])
        assert '- "Research (extended)" (was "Research"): +1 nodes, 1 edited' in text and "Nodes: +3 added / -1 removed / 1 edited." in text

    def test_moves_are_no_edits(self, spark):
        a, b = nodes_df(spark, [node(0, "a", text="t ")]), nodes_df(spark, [node(0, "a", 500, text="t")])
        assert diff.node_changes(a, b).count() == 0

    @pytest.mark.parametrize(("before", "after", "want"), [(2, 1, ("removed", 1)), (2, 3, ("added", 1)), (2, 2, None)])
    def test_connections_are_bags(self, spark, before, after, want):
        e = lambda n: spark.createDataFrame([("b", i, f"c{i}{n}", "x", "y", None) for i in range(n)], "board_id string, ord long, connector_id string, from_node_id string, to_node_id string, label string")
        got = diff.connection_changes(e(before), e(after)).collect()
        assert [(r["change"], r["n"]) for r in got] == ([want] if want else [])

    def test_greedy_matching_equals_sequential(self, spark):
        import random

        rng = random.Random(5)
        pairs = [(f"b{k}", f"c{i}", i, 10, f"d{j}", j, 10, rng.randint(1, 4)) for k in range(6) for i in range(8) for j in range(8) if rng.random() < 0.5]
        df = spark.createDataFrame(pairs, "board_id string, b_id string, b_ord int, b_size int, a_id string, a_ord int, a_size int, overlap int")
        want, used = set(), set()
        for p in sorted(pairs, key=lambda p: (p[0], -p[7], p[2], p[5])):
            if (p[0], p[1]) not in used and (p[0], p[4]) not in used:
                used |= {(p[0], p[1]), (p[0], p[4])}
                want.add((p[0], p[1], p[4]))
        assert {(r["board_id"], r["b_id"], r["a_id"]) for r in diff.greedy_match(df).collect()} == want


class TestModels:
    def test_replies_and_fallback(self):
        from boardlens.plans import models

        assert models.parse_reply('```json\n{"a": 1}\n```') == {"a": 1}
        with pytest.raises(models.ModelFailed):
            models.parse_reply("{", finish="length")
        waits, asked = [], []

        def call(model, messages, form):
            asked.append((model, form))
            if model == "m1" and form == "json_schema":
                raise models.Unsupported
            if model == "m1":
                raise models.RateLimited(60)
            return '{"ok": true}'

        assert models.chat_json(call, ("m1", "m2"), "q", sleep=waits.append) == {"ok": True}
        assert waits == [5.0] and asked[0] == ("m1", "json_schema") and asked[-1] == ("m2", "json_schema")

    @pytest.mark.parametrize(("reply", "ok"), [({"result": 42}, True), ({"result": "42"}, False), ({"result": 42, "x": 1}, False), ([42], False), ({"result": True}, False)])
    def test_strict_shapes(self, reply, ok):
        from boardlens.plans import models

        assert models.accepts(reply, "result", 42) is ok

    def test_config_and_diagnosis(self, spark):
        from boardlens.plans import models

        presets = {"p": models.ModelConfig("p", ("v1",), ("t1",), ("f1",))}
        c = models.read_config(presets, "p", {"LLM_VISION_MODEL": "own", "LLM_TEXT_MODELS": "a, b,a"})
        assert c.vision == ("own", "v1") and c.text == ("a", "b") and c.fast_text == ("f1",)
        with pytest.raises(ValueError):
            models.read_config(presets, "p", {"LLM_MODEL_PRESET": "zz"})
        answers = {"a": '{"result": 42}', "f1": '{"result": 63}', "own": '{"dominantColor": "red"}'}
        got = models.diagnose(spark, c, lambda m, q, f: answers[m]).collect()
        assert [r["ok"] for r in got] == [True, True, False] and not got[0]["all_ok"]


def board_doc(text="First sticky text of the board that is long enough to be read", image="img-1", moved=0):
    box = lambda x, y: {"x": x, "y": y, "width": 100, "height": 100}
    kids = [
        {"id": "n1", "name": "Sticky", "type": "STICKY", "absoluteBoundingBox": box(0 + moved, 0), "characters": text},
        {"id": "n2", "name": "Picture", "type": "SHAPE", "absoluteBoundingBox": box(2000, 0), "fills": [{"type": "IMAGE", "imageRef": image}]},
        {"id": "k1", "name": "Connector", "type": "CONNECTOR", "characters": "leads to", "connectorStart": {"endpointNodeId": "n1"}, "connectorEnd": {"endpointNodeId": "n2"}},
    ]
    return json.dumps({"document": {"id": "0:0", "name": "Doc", "type": "DOCUMENT", "children": [{"id": "0:1", "name": "Page", "type": "CANVAS", "children": kids}]}})


class TestEngine:
    def docs(self, spark, **boards):
        from boardlens.plans.engine import parse_documents

        return parse_documents(spark.createDataFrame(list(boards.items()), "board_id string, raw string"))

    def test_life_of_boards(self, spark, tmp_path):
        from boardlens.plans.engine import BoardEngine

        e = BoardEngine(spark, f"file://{tmp_path}", provider=lambda row: {"label": f"Seen {row['cluster_id']}", "summary": "A picture of things. More.", "modelId": "m", "confirmedNodeIds": ["n2"]})
        r = {x["board_id"]: x for x in e.ingest(self.docs(spark, BoardA1=board_doc(), BoardB2=board_doc(text=None)), now_ms=1000).collect()}
        assert r["BoardA1"]["deterministic_clusters"] == 1 and r["BoardA1"]["vision_clusters"] == 1 and "2 clusters" in r["BoardA1"]["summary"]
        again = e.ingest(self.docs(spark, BoardA1=board_doc()), now_ms=2000).first()
        assert again["cached_clusters"] == 2 and "Loaded 2 clusters from cache" in again["summary"] and again["snapshot_id"] == r["BoardA1"]["snapshot_id"]
        third = e.ingest(self.docs(spark, BoardA1=board_doc(image="img-2")), now_ms=3000).first()
        assert third["reused"] == 1 and third["snapshot_id"] != again["snapshot_id"]
        text = e.context("BoardA1").first()["context_text"]
        assert "2 of 2 clusters" in text and "Seen cluster_2" in text and '— "leads to"' in text
        a = e.answer("BoardA1", "Which sticky text is there?")
        assert "First sticky text of the board" in a["cited"][0]
        d = e.diff("BoardA1")
        assert d["stats"]["edited_nodes"] == 1 and d["stats"]["modified_clusters"] == 1 and d["stats"]["unchanged_clusters"] == 1 and "1970-01-01T00:00:01Z to 1970-01-01T00:00:03Z" in d["text"]
        with pytest.raises(LookupError):
            e.diff("BoardB2")
        with pytest.raises(LookupError):
            e.diff("Missing1")

    def test_failed_provider_falls_back(self, spark, tmp_path):
        from boardlens.plans.engine import BoardEngine

        def broken(row):
            raise TimeoutError

        r = BoardEngine(spark, f"file://{tmp_path}", provider=broken).ingest(self.docs(spark, BoardA1=board_doc())).first()
        assert r["fallbacks"] == 1 and r["deterministic_clusters"] == 2 and "text fallback" in r["summary"]

    def test_memory(self):
        from boardlens.sources.snapshots import BoardCache

        c = BoardCache(2)
        c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
        assert c.get("b") is None and c.get("a") == 1 and c.get("c") == 3


def test_streaming_history(spark, tmp_path):
    from boardlens.streaming.history import dedupe_history

    rows = [("b", 0, "k1"), ("b", 1, "k2"), ("b", 2, "k2"), ("c", 0, "k2"), ("b", 3, "k1")]
    spark.createDataFrame(rows, "board_id string, seq long, cache_key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("board_id string, seq long, cache_key string").parquet(str(tmp_path / "in"))
    q = dedupe_history(stream).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["board_id"], r["seq"], r["cache_key"]) for r in spark.table("deduped").collect())
    assert got == [("b", 0, "k1"), ("b", 1, "k2"), ("b", 3, "k1"), ("c", 0, "k2")]


def test_rest_source(spark, tmp_path):
    from boardlens.sources import rest

    (tmp_path / "k1").write_text('{"document": 1}')
    (tmp_path / "k2").write_text("{}")
    spark.dataSource.register(rest.BoardDocuments)
    got = spark.read.format("board_documents").option("base", f"file://{tmp_path}").option("keys", "k1, k2").load().orderBy("ord").collect()
    assert [(r["board_id"], r["raw"]) for r in got] == [("k1", '{"document": 1}'), ("k2", "{}")]
    assert "Retry after 9 seconds" in rest.describe_status(429, "x", "/p", "9") and "404" in rest.describe_status(404, "x", "/p")
    assert rest.image_addresses(b'{"meta": {"images": {"a": "u", "b": null}}}') == {"a": "u"}


def test_components_in_one_task(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = lambda x: {r["node"]: r["component"] for r in x.collect()}
    assert rows(components.local_components(df)) == rows(components.connected_components(df))
    assert rows(components.local_components(df.limit(0))) == {}


@pytest.mark.parametrize("local", [components.LOCAL_EDGES, 50])
def test_components_by_board(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(5)
    edges = [(b, f"{rng.randrange(n)}", f"{rng.randrange(n)}") for b, n in (("a", 300), ("b", 20), ("c", 80)) for _ in range(n // 2)]
    edges += [("a", "x", "x"), ("b", None, "3"), ("a", "0", "1"), ("a", "0", "1")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for b, u, v in edges:
        if u is not None:
            parent[max(find((b, u)), find((b, v)))] = min(find((b, u)), find((b, v)))
    df = spark.createDataFrame(edges, "board string, a string, b string")
    got = {(r["board"], r["node"]): (r["board"], r["component"]) for r in components.connected_components(df, keys=("board",)).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(df.limit(0), keys=("board",)).count() == 0
