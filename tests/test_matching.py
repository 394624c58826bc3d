import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import similarity as s
from shelfspark.operators import cross_store, graph, matching


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcde 1", k=rng.randrange(30))) for _ in range(2))
        assert s.lcs_length(a, b) == plain_lcs(a, b)


def test_ratios():
    assert s.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert s.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert s.token_set_ratio("", "x") == 0.0
    # cola and tea are 5 edits apart; both texts hold 10 + 9 characters.
    assert s.token_set_ratio("pepsi cola", "pepsi tea") == pytest.approx(100 - 100 * 5 / 19)
    assert s.partial_ratio("pepsi", "diet pepsi can") == 100.0
    assert s.partial_ratio("pepsi", "popsi can") == 80.0
    assert s.partial_ratio("", "x") == 0.0


def test_normalized_names(cell):
    def name(title, value, unit):
        return cell(s.normalize_name("t", "v", "u"), t=title, v=value, u=unit)
    assert name("Fresh Red Chilli Powder", 0.2, "kg") == "red chilli powder 200g"
    assert name("Pepsi 1.5 lt", 1.5, "l") == "pepsi 1.5 lt 1500ml"
    assert name("New  Eggs 12 pcs", 12.0, "pc") == "eggs 12 pcs 12.0pc"
    assert cell(s.token_sort_ratio("a", "b"), a="pepsi 500ml", b="500ml  pepsi") == 100.0


def test_fuzzy_query(spark):
    rows = spark.createDataFrame([("Pepsi 1L",), ("Pepsl 1L",), ("Tea",), (None,)], "title string")
    got = [r["title"] for r in rows.where(s.match_fuzzy("title", "Pepsi 1L")).collect()]
    assert got == ["Pepsi 1L", "Pepsl 1L"]


@pytest.mark.parametrize("query", ["Pepsi 1L", "Coca Cola Zero 500ml", "tea", "Sunsilk Shampoo", "a", "", "  "])
def test_fuzzy_bounds_lose_nothing(spark, query):
    rng = random.Random(len(query))
    letters = "aelPpsi 1LCocTt" + query
    titles = ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(300)]
    for _ in range(300):  # the query changed in a few places, between other words
        text = list(query)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text[at:at + rng.randrange(2)] = rng.choice(["", "x", " ", "\u00a0"])
        titles.append(rng.choice(["", "Big ", "New Pack of "]) + "".join(text) + rng.choice(["", " 6 x", " can"]))
    titles += [None, query, " ".join(reversed(query.split()))]
    rows = spark.createDataFrame([(t,) for t in titles], "title string").select(
        "title", s.match_fuzzy("title", query).alias("got"), s.may_match(F.col("title"), query).alias("may"),
        s.match_all_tokens("title", query).alias("strict")).collect()
    for r in rows:
        alike = r["title"] is not None and (s.token_set_ratio(r["title"], query) >= 80 or any(
            s.partial_ratio(w, r["title"]) >= 90 for w in query.split()))
        assert bool(r["got"]) == bool(r["strict"] or alike), r["title"]
        assert r["may"] or not alike, r["title"]


def random_names(n, seed):
    rng = random.Random(seed)
    words = ["red", "tea", "rice", "oil", "soap", "cola", "brand#12", "brand#21", "éclair", "x"]
    names = {" ".join(rng.choices(words, k=rng.randrange(1, 5))) + f" {rng.randrange(60)}0ml"
             for _ in range(n)}
    return sorted(names | {"a", "ab", "aaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaab"})


def brute_force(names, threshold):
    texts = [" ".join(sorted(n.split())) for n in names]
    return {(i, j): s.ratio(texts[i], texts[j])
            for i in range(len(names)) for j in range(i + 1, len(names))
            if s.ratio(texts[i], texts[j]) >= threshold}


@pytest.mark.parametrize("threshold, hot", [(85, 20_000), (85, 3), (70, 20_000), (50, 5), (100, 9)])
def test_similar_pairs_lose_nothing(spark, threshold, hot):
    names = random_names(160, threshold)
    df = spark.createDataFrame(list(enumerate(names)), "ord long, normalized_name string")
    rows = matching.similar_pairs(df, threshold, hot).collect()
    got = {tuple(sorted((r["a"], r["b"]))): r["score"] for r in rows}
    assert len(rows) == len(got)
    assert got == pytest.approx(brute_force(names, threshold))


def test_exploded_names_are_not_broadcast(spark):
    df = spark.createDataFrame(list(enumerate(random_names(30, 1))), "ord long, normalized_name string")
    plan = matching.similar_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key#" not in plan and "SortMergeJoin [key#" in plan


def test_best_k_with_ties(spark):
    names = random_names(120, 3)
    df = spark.createDataFrame(list(enumerate(names)), "ord long, normalized_name string")
    pairs = brute_force(names, 85)
    want = {}
    for i in range(len(names)):
        near = [(-100.0, i)] + [(-v, b if a == i else a) for (a, b), v in pairs.items() if i in (a, b)]
        want[i] = [j for _, j in sorted(near)[:4]]
    got = {}
    for r in matching.top_k_similar(df, 4, 85).orderBy("ord", "place").collect():
        got.setdefault(r["ord"], []).append(r["match"])
    assert got == want


def greedy(n, edges):
    leader, claims = {}, {}
    for a, b in edges:
        claims.setdefault(a, []).append(b)
    for i in range(n):
        if i in leader:
            continue
        leader[i] = i
        for b in claims.get(i, ()):
            leader.setdefault(b, i)
    return leader


@pytest.mark.parametrize("rounds, most", [(99, 9), (0, 1_000), (1, 20), (1, 1_000)])
def test_leaders_equal_greedy(spark, rounds, most):
    rng = random.Random(rounds + most)
    n = 60
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "ord long")
    got = matching.elect_leaders(nodes, spark.createDataFrame(edges, "src long, dst long"), rounds, most)
    assert {r["ord"]: r["leader"] for r in got.collect()} == greedy(n, edges)


def test_chain_of_names_ends_in_few_rounds(spark, monkeypatch):
    n, writes = 1_000, []
    order = random.Random(5).sample(range(n), n)  # a component in no order of appearance
    edges = [(i, i + 1) for i in range(n - 1)] + [
        (n + min(a, b), n + max(a, b)) for a, b in zip(order, order[1:])]
    for module in (matching, graph):
        monkeypatch.setattr(module, "cut_lineage", lambda df, f=module.cut_lineage: writes.append(1) or f(df))
    nodes = spark.createDataFrame([(i,) for i in range(2 * n)], "ord long")
    got = matching.elect_leaders(nodes, spark.createDataFrame(edges, "src long, dst long"))
    assert {r["ord"]: r["leader"] for r in got.collect()} == greedy(2 * n, sorted(edges))
    assert len(writes) < 100  # rounds of peeling alone would take 500 times 4


def test_components(spark):
    rng = random.Random(6)
    edges = [tuple(rng.sample(range(200), 2)) for _ in range(120)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    head = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in head:
        for a, b in edges:
            if a != b:
                head[a] = head[b] = min(head[a], head[b])
    got = graph.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in got} == head and len(got) == len(head)
    assert graph.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_groups_of_listings(spark):
    rows = spark.createDataFrame([
        (1, "A", "pepsi cola bottle 500ml", "10"), (2, "B", "pepsi cola bottle 500ml", "12"),
        (3, "A", "pepsi cola bottles 500ml", "14"), (4, "A", "green tea", "5"),
        (5, "A", "green tea", "6"), (6, "B", "free", "0")],
        "seq long, site string, title string, price string").withColumns({
            "size_value": F.lit(None).cast("double"), "size_unit": F.lit(None).cast("string")})
    got = {r["seq"]: r["product_group_id"] for r in matching.match_products(rows).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1] == got[2] == got[3] and got[1] % 2 == 0
    assert got[4] != got[5] and got[4] % 2 == got[5] % 2 == 1


def test_names_that_share_an_order_key_stay_apart(spark):
    rows = spark.createDataFrame([
        (1, "A", "green tea pack 20", "10"), (1, "B", "pepsi cola 500ml", "12"),
        (1, "C", "pepsi cola 500ml", "14"), (1, "D", "green tea pack 20", "9"),
        (1, "A", "olive oil", "5"), (1, "A", "olive oil", "5")],
        "seq long, site string, title string, price string").withColumns({
            "size_value": F.lit(None).cast("double"), "size_unit": F.lit(None).cast("string")})
    groups = {}
    for r in matching.match_products(rows).collect():
        groups.setdefault(r["product_group_id"], []).append(r["title"])
    assert sorted(groups.values()) == [
        ["green tea pack 20"] * 2, ["olive oil"], ["olive oil"], ["pepsi cola 500ml"] * 2]


def test_group_ranks_and_stores(spark):
    rows = spark.createDataFrame(
        [(1, "A", 10.0), (1, "B", 10.0), (1, "C", 30.0), (2, "A", 5.0)],
        "product_group_id long, site string, price_numeric double")
    got = cross_store.with_group_features(rows)
    first = {r["site"]: r for r in got.where("product_group_id = 1").collect()}
    assert [round(first[s]["price_percentile"]) for s in "ABC"] == [50, 50, 100]
    assert [first[s]["store_rank"] for s in "ABC"] == [1, 1, 3]
    assert [first[s]["is_cheapest"] for s in "ABC"] == [1, 1, 0]
    assert first["A"]["median_price"] == 10.0 and first["A"]["num_stores"] == 3
    alone = got.where("product_group_id = 2").first()
    assert alone["std_price"] == 0.0 and alone["price_vs_avg_pct"] == 0.0
    stores = {r["site"]: r["cheapest_rate"] for r in cross_store.store_competitiveness(got).collect()}
    assert stores == {"A": 100.0, "B": 100.0, "C": 0.0}
