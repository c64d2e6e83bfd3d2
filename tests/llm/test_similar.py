"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random
import uuid

import corpus_pipeline
from leafwire.llm import simhash, similar


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([b" ".join(w)])


def brute(plain):
    sets = [shingles(t) for _, t in plain]
    parent = list(range(len(plain)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    return {min(plain[j][0] for j in range(len(plain)) if top(j) == i) for i in range(len(plain)) if top(i) == i}


def test_stage_drops_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()} == brute(plain)


def test_groups_of_near_copies(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    plain = []
    for g in range(4):
        base = [word() for _ in range(200)]
        for _ in range(30):  # chains: neighbours are near, the ends are not
            base = list(base)
            base[r.randrange(200)] = word()
            plain.append((len(plain), " ".join(base)))
        plain += [(len(plain) + i, " ".join([*base[:150], *[word() for _ in range(50)]])) for i in range(20)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in plain], "doc_id long, text string, lang string, source string, n_chars long")
    for block in (7, 500):
        judged = similar.near_copies(docs, block).collect()
        assert {x["doc_id"] for x in judged if x["doc_id"] == x["component_id"]} == brute(plain)


def tasks_of(spark, act):
    """What ``act`` gives, and the tasks it took with 16 partitions in each shuffle."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    name = uuid.uuid4().hex
    try:
        for k, v in zip(was, ("16", "false")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(name, name)
        out = act()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in was.items():
            spark.conf.set(k, v)
    seen = spark.sparkContext.statusTracker()
    stages = {i for job in seen.getJobIdsForGroup(name) for i in seen.getJobInfo(job).stageIds}
    return out, sum(x.numCompletedTasks for x in map(seen.getStageInfo, stages) if x)


def test_components_of_chains_stars_and_random_edges_take_few_tasks(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(3000 + r.randrange(300), 3000 + r.randrange(300)) for _ in range(250)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for u, v in edges:
            parent[u] = parent[v] = min(parent[u], parent[v])
    got, tasks = tasks_of(spark, lambda: simhash.components(spark.createDataFrame(edges * 2, "u long, v long").repartition(16)).collect())
    alone = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    assert sorted(map(tuple, got)) == sorted((n, p) for n, p in parent.items() if n not in alone)
    assert tasks < 1400


def test_groups_of_near_copies_take_few_tasks(spark):
    """The disk of a run of many small tasks is their shuffle files; this is what the pipeline failed by."""
    r = random.Random(6)
    plain = []
    for _ in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for _ in range(30):
            base = list(base)
            base[r.randrange(200)] = f"w{r.randrange(10**6)}"
            plain.append((len(plain), " ".join(base)))
    docs = spark.createDataFrame(plain, "doc_id long, text string")
    got, tasks = tasks_of(spark, lambda: similar.near_copies(docs).collect())
    assert {x["doc_id"] for x in got if x["doc_id"] == x["component_id"]} == brute(plain)
    assert tasks < 1900


def test_tables_catch_pairs_of_the_least_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    for classes in (1000, 300_000):
        plan = similar.tables(classes)
        missed = 0
        for _ in range(400):
            same, own = r.integers(0, 1 << 63, 160, np.uint64), r.integers(0, 1 << 63, (2, 20), np.uint64)
            prints = np.stack([similar.fingerprint(np.concatenate([same, x]), plan.words) for x in own])
            a, b = similar.buckets(prints, plan)
            missed += not (a == b).any() or np.bitwise_count(prints[0, -2:] ^ prints[1, -2:]).sum() > plan.reach
        assert missed <= 3  # the expected number is under 0.3
    assert similar.caught(20, 2, 0.0) == 1.0 and similar.tables(10**9).blocks > similar.tables(10**6).blocks


def test_odd_rows(odd_docs, empty_docs):
    judged = {(r["doc_id"], r["component_id"]) for r in similar.near_copies(odd_docs).collect()}
    assert (6, 5) in judged and (7, 5) in judged and {(2, 2), (3, 2), (4, 2)} <= judged
    clash = odd_docs.withColumnsRenamed({"words": "_id", "found": "_own", "lang": "_print"})
    got = similar.drop_near_copies(clash)
    assert got.columns == clash.columns and {r["_id"] for r in got.collect()} == {"clash"}
    assert similar.near_copies(empty_docs).count() == 0
