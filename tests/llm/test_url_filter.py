import itertools
import random
import re

from pyspark.sql import functions as F

from tidelog.llm import url_filter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def listed(host, path):
    best = None
    for h, p, v in U.LISTED:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_parts_and_listed_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "https://É.Example.net/de/88", "a://b://c/d", "http://com/en/", "http://xcom/en/"]
    for _ in range(200):
        urls.append(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'm.', 'a.b.'])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/'])}{rng.choice(['en', 'de', 'es', ''])}/{rng.randint(0, 99)}{rng.choice(['', '?a=/x', '#/en/'])}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = sorted(U.judge(pages, []).collect(), key=lambda r: r.page_id)
    for r, url in zip(rows, urls, strict=True):
        host, path = parts(url)
        rule = listed(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(rule or (None, "allow")))


def test_mining_matches_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c = rng.choice(["ab", "cd", "ef"]), rng.choice(["x", "y"]), rng.choice(["q1", "q2"])
        bad = (a == "ab" and b == "x") or rng.random() < 0.1
        rows.append((f"http://{a}.site.org/{b}/{i}?{c}=1", bad if rng.random() < 0.9 else None))
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    mined = U.mine_rules(frame, 0.05, 0.8, chance=1e9)
    known = [(set(t), bad) for t, bad in ((r.t, r.bad) for r in frame.select(U.url_tokens(F.col("url")).alias("t"), "bad").collect()) if bad is not None]
    items = sorted(set().union(*(t for t, _ in known)))
    found = {}
    for size in (1, 2, 3):
        for combo in itertools.combinations(items, size):
            own = [bad for t, bad in known if set(combo) <= t]
            if sum(own) >= 0.05 * len(known) and sum(own) / len(own) >= 0.8:
                found[combo] = sum(own) / len(own)
    want = [(t, c) for t, c in sorted(found.items()) if not any(found.get(p, -1) >= c for k in range(1, len(t)) for p in itertools.combinations(t, k))]
    assert [t for t, _ in mined] == [t for t, _ in want] and ("host:ab", "path:x") in dict(mined)
    out = {r.url: r for r in U.judge(frame, mined).collect()}
    for url, r in out.items():
        tokens = {t for t in frame.filter(F.col("url") == url).select(U.url_tokens(F.col("url"))).first()[0]} if url.endswith("/7?q1=1") else None
        fits = ".org/" in url and url.startswith("http://ab.site") and "/x/" in url
        assert (r.verdict == "block") == fits or tokens is not None


def test_defined_cases(spark):
    pages = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "x", 5)], "page_id long, url string, host int")
    rows = U.judge(pages, [(("host:a",), 0.9)]).collect()
    assert len(rows) == 3 and {(r.host, r.path, r.rule, r.verdict) for r in rows} == {("", "", None, "allow")}
    assert U.judge(pages.filter("false"), []).count() == 0
    assert U.mine_rules(pages.select("url", F.lit(None).cast("boolean").alias("bad"))) == []


def test_chance_rules_are_dropped(spark):
    rng = random.Random(4)
    rows = [(f"http://{rng.choice('abcdefgh')}{rng.choice('klmnop')}.{rng.choice('uvwxyz')}.org/{rng.choice('abc')}/{i}", rng.random() < 0.45) for i in range(600)]
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    assert U.mine_rules(frame, 0.002, 0.8, 3, chance=1e9) and U.mine_rules(frame, 0.002, 0.8, 3) == []
    for hits, n, rate in ((3, 5, 0.2), (0, 4, 0.3), (7, 7, 0.5)):
        every = sum(rate ** sum(x) * (1 - rate) ** (n - sum(x)) for x in itertools.product((0, 1), repeat=n) if sum(x) >= hits)
        assert abs(U._tail(hits, n, rate) - every) < 1e-12


def test_number_of_combinations_is_bounded_before_mining(spark):
    rows = [("http://h.org/" + "/".join(f"w{k}" for k in range(40) if (i >> (k % 5)) & 1), i % 3 == 0) for i in range(96)]
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    assert isinstance(U.mine_rules(frame, 0.01, 0.5, 1, max_sets=100), list)
    known = frame.select("bad", U.url_tokens(F.col("url")).alias("items"))
    kept, least = U._frequent(known, 1, 100)
    assert least > 40 and kept.filter(F.size("items") > 12).isEmpty()


def test_columns_with_the_names_used_inside(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "t", "m")], "page_id long, url string, _tokens string, mined_rule string")
    (row,) = U.judge(pages, [(("host:a", "path:x"), 0.9)]).collect()
    assert (row._tokens, row.mined_rule, row.verdict) == ("t", "host:a path:x", "block")


def test_rules_of_four_tokens_are_kept(spark):
    urls = [(f"http://{a}.{b}.org/{c}/{i}?{q}=1", (a, b, c, q) == ("ab", "x", "p", "k")) for i, (a, b, c, q) in enumerate(itertools.product(["ab", "cd"], ["x", "y"], ["p", "r"], ["k", "m"])) for _ in range(10)]
    mined = U.mine_rules(spark.createDataFrame(urls, "url string, bad boolean"), 0.05, 0.8)
    assert mined == [(("host:ab", "host:x", "path:p", "query:k"), 1.0)]


def test_rules_below_the_raised_support_are_found(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        tokens = [t for t in "abcd" if rng.random() < 0.5]
        rare = i % 57 == 0
        rows.append((f"http://h{i % 3}.org/{'/'.join(tokens)}{'/rare/twin' if rare else ''}", rare or {"a", "b", "c"} <= set(tokens) or rng.random() < 0.05))
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    known = [(set(r.t), r.bad) for r in frame.select(U.url_tokens(F.col("url")).alias("t"), "bad").collect()]
    items = sorted(set().union(*(t for t, _ in known)))
    rules = {}
    for size in range(1, len(items) + 1):
        for combo in itertools.combinations(items, size):
            own = [bad for t, bad in known if set(combo) <= t]
            if sum(own) >= 5 and sum(own) / len(own) >= 0.8:
                rules[combo] = (sum(own), len(own))
    rate = sum(bad for _, bad in known) / len(known)
    for chance, table_rows in ((1e9, 5), (0.01, None)):
        found = {t: h / n for t, (h, n) in rules.items() if U._tail(h, n, rate) * len(rules) <= chance}
        want = {t: c for t, c in found.items() if not any(found.get(p, -1) >= c for k in range(1, len(t)) for p in itertools.combinations(t, k))}
        mined = U.mine_rules(frame, 0.0125, 0.8, 5, chance, max_sets=300, **({"table_rows": table_rows} if table_rows else {}))
        assert dict(mined) == want and {("path:rare",), ("path:twin",), ("path:a", "path:b", "path:c")} <= want.keys()


def test_growth_counts_every_combination_once():
    rng = random.Random(6)
    for _ in range(60):
        table = {}
        for _ in range(rng.randint(1, 12)):
            items = tuple(t for t in range(6) if rng.random() < 0.6)
            table[tuple(sorted({*items, *((7, 8) if 1 in items else ()), 9}))] = (rng.randint(0, 3), rng.randint(0, 2))
        rows = [(list(items), bad, bad + good or 1) for items, (bad, good) in table.items()]
        least, below, confidence = rng.randint(1, 4), rng.randint(4, 12), rng.choice([0.1, 0.5, 0.8])
        want = {}
        for size in range(10):
            for combo in itertools.combinations([*range(6), 7, 8, 9], size):
                own = [(h, n) for items, h, n in rows if set(combo) <= set(items)]
                h, n = sum(x for x, _ in own), sum(x for _, x in own)
                if least <= h < below and h / n >= confidence:
                    want[combo] = (h, n)
        got = list(U.grow(rows, least, below, confidence))
        assert sum(w for *_, w in got) == len(want)
        spelt = [(tuple(sorted(x)), (h, n)) for units, h, n, _ in got if h for x in itertools.product(*units)]
        assert len(dict(spelt)) == len(spelt) and dict(spelt).items() <= want.items()


def test_very_many_alike_tokens_are_not_spelt_out(spark):
    path = "/".join(f"w{k}" for k in range(60))
    rows = [(f"http://h{i % 5}.org/{path if i % 10 == 0 else 'x'}/{i}", i % 10 == 0) for i in range(500)]
    mined = U.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.02, 0.8, 5, chance=1e30)
    assert mined == sorted(((f"path:w{k}",), 1.0) for k in range(60))
