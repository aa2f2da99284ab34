import re

from wattle.llm import url_vocabulary as U


def judge(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else None
    host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
    path = re.match(r"[^?#]*", rest[len(host):])[0] if rest is not None else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    hit = lambda t: re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low) is not None
    strict, soft = sum(map(hit, U.STRICT)), sum(map(hit, U.SOFT))
    return host, path, rule, verdict or ("block" if strict or soft >= 2 else "allow"), strict, soft


URLS = [None, "", "no scheme", "http://", "://", "http://A.Example.NET/en/x?y#z", "https://example.com/de/1", "http://m.example.com/DE/1", "http://x.net", "http://x.net/", "http://net/en/",
        "http://org/fr/", "http://a.org/fr/1", "http://a.org/fr", "http://aorg/fr/", "http://h?u://v/w", "http://h#/p", "ftp://casino-win.example.com/a", "http://casinowin.example.com", "http://h/casino/casino",
        "http://h/CASINO-Poker", "http://h/xxx", "http://h/xxxl", "http://h/sex-cams", "http://hardcore-sex.example.org/", "http://ü.example.org/fr/ß", "http://h\n/p\nq", "a://b://c/d", "http://example.net/en/" + "x/" * 5000]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string").repartition(2)
    out = U.judge(df).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict, r.n_strict, r.n_soft) == judge(URLS[r.page_id]), URLS[r.page_id]


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "http://x.net/"), (1, "http://x.net/"), (1, "http://x.net/")], "page_id long, url string")
    assert [r.verdict for r in U.judge(df).collect()] == ["block"] * 3
    assert U.judge(df.limit(0)).count() == 0
