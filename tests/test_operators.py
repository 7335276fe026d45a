import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import ed25519
from tessella.functions import text as T
from tessella.operators import answers, closure, detection, graph, layout, paths, portable, provenance, registry, render, trust
from tessella.sources.corpus import registers, text_files
from tessella.sources.schemas import TABLES
from tessella.sources.store import Store

EDGE = "id string, from_id string, to_id string, family string, sigma string, weight double, confidence double, evidence array<string>, quarantined boolean, reason string"


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, "supplies", "factual", w, c, e, q, None) for i, a, b, w, c, e, q in rows], EDGE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- signatures and canonical forms -----------------------------------------------------------


def test_rfc_8032_vectors():
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert ed25519.public_key(seed).hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    signature = ed25519.sign(seed, b"\x72")
    assert signature.hex().startswith("92a009a9f0d4cab8720e820b5f642540") and ed25519.verify(ed25519.public_key(seed), b"\x72", signature)
    assert not ed25519.verify(ed25519.public_key(seed), b"\x73", signature)


def test_canonical_json_and_the_browsers_form():
    assert trust.canonical_bytes({"b": 1.0, "a": [None, True, "é", -0.0]}).decode() == '{"a":[null,true,"é",-0.0],"b":1.0}'
    assert trust.demo_canonical({"b": 1.0, "a": [None, True, "é", -0.0]}) == '{"a":[null,true,"é",0],"b":1}'
    with pytest.raises(ValueError):
        trust.canonical_bytes({"x": float("nan")})


def test_envelopes_fail_at_the_first_check(spark):
    good = trust.sign_one({"answer": "yes"}, "render_trace", bytes(32), "2024-01-01T00:00:00+00:00")
    cases = [
        (good, "ok"),
        (good | {"attestation_version": 2}, "version"),
        ({k: v for k, v in good.items() if k != "signed_at"}, "missing_fields"),
        (good | {"payload": {"answer": "no"}}, "payload_hash"),
        (good | {"public_key": "!!"}, "encoding"),
        (good | {"key_id": "ed25519:0"}, "key_id"),
        (good | {"signed_at": "2025"}, "signature"),
        ([], "unreadable"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _) in enumerate(cases)] + [(99, None)], "i int, e string")
    got = {r.i: (r.v.valid, r.v.reason) for r in rows.select("i", trust.verified("e").alias("v")).collect()}
    assert got == {i: (w == "ok", w) for i, (_, w) in enumerate(cases)} | {99: (False, "unreadable")}
    with pytest.raises(ValueError):
        trust.sign_one({}, "other", bytes(32), "")


def test_tampering_and_digests(spark):
    assert [one(spark, trust.tampered(F.lit(x))) for x in ("a9b", "aB", "--")] == ["a0b", "AB", "--"]
    assert one(spark, T.qualified_digest(F.lit("AB" * 32))) == "sha256:" + "ab" * 32
    with pytest.raises(Exception, match="unknown digest"):
        one(spark, T.qualified_digest(F.lit("md5:00")))
    assert len({one(spark, T.line_hash(F.lit(x))) for x in ("a\nb", "a\r\nb", "a\rb")}) == 1


# -- text -------------------------------------------------------------------------------------


def test_terms_fit_and_tokens(spark):
    terms = one(spark, T.content_terms(F.lit("Who supplies the Steel-pipe, steel-pipe and ÅRE?")))
    assert terms == ["supplies", "steel-pipe", "åre"]
    assert one(spark, T.question_fit(F.array(F.lit("ab"), F.lit("cd")), F.lit("xABx"))) == 0.5
    assert [one(spark, T.token_count(F.lit("x" * n))) for n in (0, 4, 5, 6, 10)] == [1, 1, 1, 2, 3]
    assert one(spark, T.normalise_space(F.lit(" a b\x1c\nc "))) == "a b c"
    assert one(spark, T.slug(F.lit("Ångström & Straße!"))) == "angstrom-strasse"


def test_chunks_and_triples(spark):
    text = "\n\n".join(["aaaa", "bbbb", "c" * 20, "dd", "ee"])
    assert one(spark, closure.chunks(F.lit(text), 8)) == ["aaaa\n\nbbbb", "c" * 20, "dd\n\nee"]
    answer = 'Sure: [["a","r","b"],["x","","y"],["p","q"]] done'
    assert one(spark, closure.parsed_triples(F.lit(answer))) == [["a", "r", "b"]]
    assert one(spark, closure.parsed_triples(F.lit("nothing"))) == []


# -- store ------------------------------------------------------------------------------------


def test_store_batches_and_upserts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("sources").count() == 0
    row = lambda i, label, at: (i, label, "", "", at, "h", 1)
    make = lambda *rows: spark.createDataFrame(list(rows), TABLES["sources"][1])
    store.put("sources", make(row("a", "A", "1"), row("b", "B", "1")))
    store.begin()
    store.put("sources", provenance.merged(store.read("sources"), make(row("b", "new", "2"), row("c", "C", "2")), ["source_id"], keep=("imported_at",)))
    store.rollback()
    assert store.read("sources").count() == 2
    store.put("sources", provenance.merged(store.read("sources"), make(row("b", "new", "2"), row("c", "C", "2")), ["source_id"], keep=("imported_at",)))
    assert sorted((r.source_id, r.source_label, r.imported_at) for r in store.read("sources").collect()) == [("a", "A", "1"), ("b", "new", "1"), ("c", "C", "2")]
    store.clear()
    assert store.read("sources").count() == 0 and store.read("provenance_meta").first().value == "1"


def test_inserts_and_late_responses(spark):
    old = spark.createDataFrame([("a", None, None), ("b", "x", "1")], "answer_id string, response_text string, response_recorded_at string")
    late = spark.createDataFrame([("a", "", "9"), ("zz", "no", "9")], old.schema)
    assert sorted(map(tuple, provenance.with_responses(old, late).collect())) == [("a", "", "9"), ("b", "x", "1")]
    with pytest.raises(ValueError):
        provenance.appended(old, late, ["answer_id"])
    assert provenance.appended(old, late.where("answer_id = 'zz'"), ["answer_id"]).count() == 3
    assert sorted(r.answer_id for r in provenance.replaced(old, late.where("answer_id = 'a'"), ["answer_id"]).collect()) == ["a", "b"]


def test_corpus_folders(spark, tmp_path):
    for name, data in {"news/a.txt": b"one", "news/b.txt": b"two", "law/c.txt": "é".encode(), "law/bad.txt": b"\xff\xfe\xff"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = text_files(spark, f"file://{tmp_path}", "*.txt")
    assert sorted(r.text for r in files.collect()) == ["one", "two", "é"]
    assert sorted((r.register, r.text) for r in registers(files, 1).collect()) == [("law", "é"), ("news", "one")]


# -- graph ------------------------------------------------------------------------------------

CHAIN = [("1", "a", "b", 1.0, 0.9, ["p"], False), ("2", "b", "c", 1.0, 0.9, ["p"], False), ("3", "a", "d", 1.0, 1.0, [], False), ("4", "d", "c", 1.0, 1.0, [], False), ("5", "c", "e", 1.0, 1.0, ["p"], True)]


def test_closure_skips_quarantine_and_caps(spark):
    e, seed = edges(spark, CHAIN), spark.createDataFrame([("a",)], "id string")
    assert sorted((r.id, r.hop) for r in paths.hop_closure(e, seed, 5).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert [r.id for r in paths.hop_closure(e, seed, 5, cap=2).collect()] == ["a", "b"]


def test_shortest_path_prefers_sure_edges(spark):
    e = edges(spark, CHAIN)
    assert [s["edge_id"] for s in paths.shortest_path(e, "a", "c")] == ["1", "2"]
    assert paths.shortest_path(e, "a", "a") == [] and paths.shortest_path(e, "a", "e") == [] and paths.shortest_path(e, "a", "c", most_hops=1) == []


def test_path_steps_read_inverses(spark):
    families = spark.createDataFrame([("supplies", "supplied_by", "factual"), ("supplied_by", "supplies", "causal")], "family string, inverse string, sigma string")
    steps = spark.createDataFrame([(1, "b", "a", "1"), (2, "b", "c", "2")], "step int, from_id string, to_id string, edge_id string")
    got = paths.path_steps(steps, edges(spark, CHAIN), families).orderBy("step").collect()
    assert [(r.family, r.sigma) for r in got] == [("supplied_by", "causal"), ("supplies", "factual")]


def test_centrality_is_the_dense_computation(spark):
    e = [("1", "a", "b", 0.5, 1.0, [], False), ("2", "b", "c", 1.0, 1.0, [], False), ("3", "c", "a", 0.2, 1.0, [], False), ("4", "c", "d", 0.9, 1.0, [], False), ("5", "a", "d", 1.0, 1.0, [], True)]
    names = "abcd"
    m = np.zeros((4, 4))
    for _, a, b, w, *_, q in e:
        if not q:
            m[names.index(a), names.index(b)] += w
            m[names.index(b), names.index(a)] += w
    x = np.ones(4)
    for _ in range(16):
        x = m @ x
        x /= np.linalg.norm(x)
    want = 0.55 * x / x.max() + 0.45 * m.sum(0) / m.sum(0).max()
    got = {r.id: r.centrality for r in paths.centrality(edges(spark, e)).collect()}
    assert [got[c] for c in names] == pytest.approx(list(want))


def test_diffusion_takes_neighbours_means(spark):
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [5.0, 5.0])], "id string, v array<double>")
    got = {r.id: r.v for r in paths.diffused(f, edges(spark, CHAIN[:1]), rounds=1, alpha=0.25).collect()}
    assert got == {"a": [0.75, 0.25], "b": [0.25, 0.75], "z": [5.0, 5.0]}


def test_vocabulary_problems(spark):
    rows = [("owns", "owned_by", "factual"), ("owned_by", "owns", "factual"), ("bad", "owns", "causal"), ("_x", None, "factual"), ("same_as", "same_as", "factual")]
    got = graph.vocabulary_problems(spark.createDataFrame(rows, "family string, inverse string, sigma string")).collect()
    assert sorted(map(tuple, got)) == [("_x", "prefix"), ("bad", "inverse_not_mutual"), ("bad", "sigma_differs")]


def test_gap_clusters_lead_by_frequency(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    freq = r.integers(1, 5, 40)
    rows = [(f"r{i:02}", int(freq[i]), v[i].tolist()) for i in range(40)]
    leaders, want = [], {}
    for name, _, x in sorted(rows, key=lambda t: (-t[1], t[0])):
        hit = next((n for n, y in leaders if np.dot(x, y) >= 0.6), None)
        want[name] = hit or name
        if not hit:
            leaders.append((name, x))
    for block in (7, 1024):
        got = closure.gap_clusters(spark.createDataFrame(rows, "relation string, freq int, v array<double>"), 0.6, block)
        assert {r.relation: r.leader for r in got.collect()} == want
    assert closure.gap_clusters(spark.createDataFrame([], "relation string, freq int, v array<double>")).count() == 0


def test_packs_never_replace_the_core(spark):
    core = spark.createDataFrame([("a", "core")], "family string, description string")
    packs = spark.createDataFrame([("a", "p1", 1), ("b", "p1", 1), ("b", "p2", 2)], "family string, description string, place int")
    assert sorted((r.family, r.description) for r in closure.with_packs(core, packs).collect()) == [("a", "core"), ("b", "p1")]


# -- rendering, layout, answers ---------------------------------------------------------------


def test_omissions_and_trace_problems(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    touching = spark.createDataFrame([("x", True, False), ("y", True, False), ("y", False, False), ("z", False, True), ("in", False, False), ("out", False, False)], "id string, quarantined boolean, structural boolean")
    got = {r.id: r.reason for r in render.omitted(ids("out"), ids("in"), touching).collect()}
    assert got == {"out": "budget_exhausted", "x": "reached_only_through_quarantined_edge", "y": "below_threshold", "z": "structural_link_only"}
    cited = spark.createDataFrame([("q", 0.5, "sha256:0"), (" ", 1.5, "md5")], "quote string, score double, content_hash string")
    found = {r.problem: r.rows for r in render.trace_problems(cited, ids("a", "a"), ids("a")).collect()}
    assert found == {"blank_quote": 1, "score_range": 1, "hash_prefix": 1, "admitted_twice": 1, "omitted_and_admitted": 1}


def test_evidence_and_candidate_passages(spark):
    e = edges(spark, [("1", "a", "b", 1.0, 0.6, ["p1", "p2"], False), ("2", "a", "c", 1.0, 0.9, ["p2"], False), ("3", "a", "d", 1.0, 1.0, [], False)])
    top = render.evidence_edges(e, "a")
    assert [r.id for r in top.collect()] == ["2", "1"]
    hops = top.withColumn("place", F.when(F.col("id") == "2", 0).otherwise(1))
    got = render.candidate_passages(hops, spark.createDataFrame([("p1", "steel pipes"), ("p2", "none")], "id string, text string"), "steel").orderBy("place", "k").collect()
    assert [(r.id, r.place, round(r.score, 6)) for r in got] == [("p2", 0, 0.45), ("p1", 1, 0.8)]


def test_layout_hash_ignores_order_and_purity(spark):
    lines = spark.createDataFrame([(f"l{i}",) for i in range(30)], "line string")
    assert layout.content_hash(lines).first() == layout.content_hash(lines.repartition(5)).first() != layout.content_hash(lines.limit(29)).first()
    p = spark.createDataFrame([("a", 0.0, 0.0, 1.0, "x"), ("b", 1.0, 0.0, 1.0, "x"), ("c", 0.0, 1.0, 1.0, "y"), ("d", 9.0, 9.0, 1.0, "y")], "id string, x double, y double, r double, community string")
    assert layout.purity(p, 1.0).first().purity == 0.5
    centres = spark.createDataFrame([("a", 10.0, 0.0)], "id string, cx double, cy double")
    assert {r.id: r.x for r in layout.pulled(p, centres, 0.8).collect()} == {"a": 8.0, "b": 1.0, "c": 0.0, "d": 9.0}
    assert layout.picked(p, 50.0, 50.0).count() == 0 and layout.bounds(p.limit(0)).first().min_x == 0.0


def test_chains_forks_and_windows(spark):
    steps = lambda *x: spark.createDataFrame(list(x), "from_id string, to_id string")
    assert sorted((r.id, r.role) for r in answers.chain_ends(steps(("a", "b"), ("b", "c"))).collect()) == [("a", "head"), ("c", "tail")]
    assert answers.chain_ends(steps(("a", "b"), ("a", "c"))).count() == 0 and answers.chain_ends(steps(("a", "b"), ("b", "a"))).count() == 0
    assert [tuple(r) for r in answers.forks(steps(("a", "z"), ("b", "z"), ("a", "y"))).collect()] == [("z", 2)]
    assert [tuple(r) for r in answers.busiest(steps(("a", "b"), ("b", "c"))).collect()] == [("b", 2)]
    assert one(spark, answers.source_window(F.lit("abcdefghij"), F.lit(4), F.lit(6), 2)) == "…cdefgh…"


def test_imports_keep_full_nodes(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, label string, stub boolean")
    once = portable.imported(rows(("a", "full", False), ("b", "stub", True)), rows(("a", "s", True), ("b", "now full", False), ("c", "s", True)))
    want = [("a", "full", False), ("b", "now full", False), ("c", "s", True)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, portable.imported(once, rows(("a", "s", True), ("b", "now full", False), ("c", "s", True))).collect())) == want
    with pytest.raises(ValueError):
        portable.checked(rows(("a", "x", False)), spark.createDataFrame([("a", "b")], "from_id string, to_id string"))


def test_edge_closure(spark):
    nodes = spark.createDataFrame([("a", "derived"), ("b", "derived"), ("c", "boundary")], "id string, scope string")
    e = spark.createDataFrame([("1", "a", "b", ["p"]), ("2", "a", "c", ["p"]), ("3", "c", "d", ["p"]), ("4", "a", "b", ["q"])], "id string, from_id string, to_id string, evidence array<string>")
    got = portable.edge_closure(e, nodes, spark.createDataFrame([("p",)], "passage_id string"))
    assert sorted(map(tuple, got.collect())) == [("1", "internal"), ("2", "boundary"), ("3", "shared")]


def test_registry():
    class Always:
        def available(self):
            return True

    r = registry.Registry()
    r.register("B1", "x", Always())
    assert r.available("B1") == ["x"] and r.available("B2") == []
    with pytest.raises(ValueError):
        r.register("B1", "x", Always())


def test_mentions_blank_longer_labels_first(spark):
    p = spark.createDataFrame([("1", "New York City and York"), ("2", "yorkshire"), ("3", None)], "id string, text string")
    labels = spark.createDataFrame([("York",), ("New York City",), ("and",)], "label string")
    assert sorted(map(tuple, detection.detected_mentions(p, labels).collect())) == [("1", "New York City"), ("1", "York"), ("1", "and")]


def test_chronology_orders_a_chain_only(spark):
    steps = lambda *x: spark.createDataFrame(list(x), "from_id string, to_id string")
    dates = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-31"), ("c", "2024-02-01T05:00:00")], "id string, at string")
    got = answers.chronology(steps(("b", "c"), ("a", "b")), dates).orderBy("place").collect()
    assert [(r.id, r.days) for r in got] == [("a", None), ("b", 30), ("c", 1)]
    for bad in ([("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")], [("a", "b"), ("c", "d")]):
        assert answers.chronology(steps(*bad), dates).count() == 0


def test_signals_and_counterfactual(spark):
    cited = spark.createDataFrame([(0.5, True, "s1"), (1.0, False, "s1")], "score double, verbatim boolean, source_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = render.signals(cited, ids("a", "b", "c", "e"), edges(spark, CHAIN), ids("a")).first()
    assert (got.semantic, got.topology, got.temporal, got.authorial) == (0.75, 0.75, None, 0.5)
    assets = spark.createDataFrame([("a", "i", 10), ("b", "i", 50), ("c", "j", 7)], "id string, island string, tokens long")
    assert tuple(render.counterfactual(ids("a"), assets, 5).first()) == (10, False) and tuple(render.counterfactual(ids("a"), assets, 20).first()) == (60, True)


def test_principal_axes_are_the_dense_ones(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(60, 4)) * [3, 2, 1, 0.5]
    got = layout.principal_axes(spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "id string, v array<double>"), 4)
    u = v - v.mean(axis=0)
    axes = np.linalg.eigh(u.T @ u / 60)[1][:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    want = {str(i): tuple(x) for i, x in enumerate(u @ axes)}
    assert all((r.px, r.py) == pytest.approx(want[r.id]) for r in got.collect())


def test_matches_traces_and_runs_without_rows(spark):
    none = spark.createDataFrame([], "id string, label string, aliases array<string>, centrality double")
    assert tuple(render.best_match(render.lexical_matches("steel pipe", none)).first()) == (None, None, None, "QUERY_NO_MATCH")
    some = spark.createDataFrame([("a", "Steel", None, 0.1), ("b", "steel", ["pipe"], 0.2), ("c", "Steel pipe", [], 0.2), ("d", "of", None, 0.9)], none.schema)
    got = render.best_match(render.lexical_matches("steel pipe of steel", some)).first()
    assert (got.best, round(got.score, 6), got.second, got.error) == ("b", 14.2, "a", None)
    runs = spark.createDataFrame([("a", "{}", "[]"), ("b", "{}", "[]")], "answer_id string, thresholds string, tiers_offered string")
    new = spark.createDataFrame([("b", {"z": 1.0, "a": None}, ["x"]), ("c", None, None)], "answer_id string, thresholds map<string,double>, tiers_offered array<string>")
    assert sorted(map(tuple, provenance.recorded_runs(runs, new).collect())) == [("a", "{}", "[]"), ("b", '{"a": null, "z": 1.0}', '["x"]'), ("c", "{}", "[]")]
    explained = spark.createDataFrame([("a", 1, "s", "q", None, None, "h", None)], "answer_id string, cite_order int, segment_id string, evidence_snippet string, source_label string, seq int, content_hash string, has_overlay boolean")
    traces = {r.answer_id: (r.coverage, len(r.citations), r.resolution_disclosure) for r in provenance.render_traces(runs, explained).collect()}
    assert traces == {"a": ("none", 1, None), "b": ("none", 0, None)}


def test_verdicts_of_an_answer_without_claims_go(spark):
    claims = spark.createDataFrame([("a", 0, "supported"), ("b", 0, "supported")], "answer_id string, claim_index int, verdict string")
    evidence = spark.createDataFrame([("a", 0, "s", 1)], "answer_id string, claim_index int, segment_id string, rank int")
    nested = spark.createDataFrame([("a", [])], "answer_id string, claims array<struct<claim_index:int,verdict:string,evidence:array<struct<segment_id:string,rank:int>>>>")
    left, cited = provenance.recorded_claims(claims, evidence, nested)
    assert [r.answer_id for r in left.collect()] == ["b"] and cited.count() == 0


def test_candidates_hold_assets_of_the_path_only(spark):
    path = spark.createDataFrame([("a", "x")], "from_id string, to_id string")
    nodes = spark.createDataFrame([("a", "entity", 0.1), ("b", "entity", 0.9), ("c", "entity", 0.5), ("x", "asset", 0.0), ("y", "asset", 1.0), ("p", "passage", 1.0)], "id string, kind string, centrality double")
    e = edges(spark, [("1", "a", "b", 1.0, 1.0, [], False), ("2", "a", "y", 1.0, 1.0, [], False), ("3", "c", "x", 1.0, 1.0, [], True), ("4", "p", "a", 1.0, 1.0, [], False)])
    seeds = spark.createDataFrame([("c",), ("missing",)], "id string")
    assert [(r.id, r.on_path) for r in render.candidate_nodes(path, seeds, e, nodes).collect()] == [("a", True), ("x", True), ("b", False), ("c", False)]


def test_steps_citations_and_directions(spark):
    path = spark.createDataFrame([("1", "a", ["p", "q", "q"]), ("2", "b", None), ("3", "c", ["p"])], "edge_id string, from_id string, evidence array<string>")
    cited = spark.createDataFrame([("p", False), ("z", True), ("w", False)], "passage_id string, bridged boolean")
    assert sorted(map(tuple, answers.hop_evidence(path, cited).collect())) == [("1", 3, 1), ("2", 0, 0), ("3", 1, 1)]
    assert sorted(map(tuple, answers.citation_edges(cited, path, "m").collect())) == [("p", "a"), ("p", "c"), ("z", "m")]
    assert answers.citation_edges(cited, path).count() == 2
    at = spark.createDataFrame([("o", 0.0, 0.0), ("same", 0.0, 0.0), ("n", 0.0, 5.0), ("ne", 1.0, 2.0), ("e", 3.0, 0.0)], "id string, x double, y double")
    assert {r.direction: r.id for r in answers.nearest_in_direction(at, "o").collect()} == {"up": "ne", "right": "e"}
    assert graph.truth_gated_rate(edges(spark, CHAIN).limit(0).withColumn("at", F.lit(""))).first().rate == 0.0
