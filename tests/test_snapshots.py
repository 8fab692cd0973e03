import datetime as dt
import random

from siteloom.operators.snapshots import snapshot_changes

SCHEMA = "host string, crawled_at string, start_url string, page_url string, status int, codes array<string>, delivered_at timestamp, bucket string, chunk int"
T = dt.datetime(2026, 1, 1)


def key(url):
    scheme, rest = url.split("://", 1)
    rest = rest.split("#", 1)[0]
    host, _, path = rest.partition("/")
    path = "/" + path
    return f"{scheme.lower()}://{host.lower()}{path.rstrip('/') or '/'}"


def brute(rows):
    best = {}
    for h, at, _, url, status, codes, when, *_ in rows:
        if None in (h, at, url):
            continue
        k, v = (h, at, key(url)), (when, status, tuple(sorted({c for c in codes or [] if c is not None})))
        order = lambda v: (v[0] or dt.datetime.min, -1 if v[1] is None else v[1], v[2])
        if k not in best or order(v) > order(best[k]):
            best[k] = v
    sites, out = {}, set()
    for (h, at, u), v in best.items():
        sites.setdefault(h, {}).setdefault(at, {})[u] = v
    for h, snaps in sites.items():
        times = sorted(snaps)
        for a, b in zip(times, times[1:]):
            old, new = snaps[a], snaps[b]
            out |= {(h, b, u, "", "added") for u in new.keys() - old.keys()} | {(h, b, u, "", "removed") for u in old.keys() - new.keys()}
            for u in new.keys() & old.keys():
                if new[u][1] != old[u][1]:
                    out.add((h, b, u, "", "changed"))
                out |= {(h, b, u, c, "added") for c in set(new[u][2]) - set(old[u][2])} | {(h, b, u, c, "removed") for c in set(old[u][2]) - set(new[u][2])}
    return out


def found(df):
    rows = [tuple(r)[:5] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force_at_any_chunking(spark):
    rng = random.Random(1)
    rows = []
    for h in ("a.example", "b.example", "hot.example"):
        urls = [f"https://{h}/p{i}" for i in range(60 if h.startswith("hot") else 8)]
        for s in range(4):
            for u in urls:
                if rng.random() < 0.85:
                    spelled = rng.choice([u, u + "/", u + "#x", u.replace("https://" + h, ("https://" + h).upper())])
                    for _ in range(rng.choice([1, 1, 2])):
                        rows.append((h, f"2026-01-0{s + 1}", None, spelled, rng.choice([200, 200, 404, None]), rng.choice([None, [], ["A"], ["B", "A", "A"], ["C", None]]), T + dt.timedelta(minutes=rng.randrange(500)), "x", 3))
    rows += [(None, "2026-01-01", None, "https://a.example/", 200, None, T, None, None), ("a.example", None, None, "https://a.example/", 200, None, None, None, None), ("a.example", "2026-01-02", None, None, 200, None, T, None, None)]
    rng.shuffle(rows)
    expected = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert expected
    assert found(snapshot_changes(df)) == expected
    assert found(snapshot_changes(df.repartition(7), chunk_rows=3, site_rows=16)) == expected


def test_empty_and_single(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("a", "1", None, "https://a/", None, None, None, None, None)] * 2, SCHEMA)
    assert snapshot_changes(one).count() == 0


def test_root_and_no_url(spark):
    rows = [("a", "1", None, "HTTPS://A.example", 200, None, T, None, 1), ("a", "2", None, "https://a.example//#f", None, None, T, None, 1), ("a", "2", None, "not a url/", 200, None, T, None, 1)]
    assert found(snapshot_changes(spark.createDataFrame(rows, SCHEMA))) == {("a", "2", "https://a.example/", "", "changed"), ("a", "2", "not a url", "", "added")}
