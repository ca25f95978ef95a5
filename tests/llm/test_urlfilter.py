import fnmatch
import random
import re

from ledgerloom.llm.queries import URL_RULES
from ledgerloom.llm.urlfilter import Automaton, url_verdicts
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, default))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/17?x#y", "http://notexample.org/es/", "http://x.com", "ftp://x.com/fr", "http://x.com/fr/ä/://z", "http://com/de/", "http://xcom/de/", "a://b.net/.org/es/", "http://é.ORG/", "http://u@h.org:80/x?y", "http://h.org?q=/", "http://h.org#/", "://example.org/en/1", "http://a.com/de/" + "x" * 60_000, "http://x.org/a\nb"]


def test_verdicts_by_brute_force(spark):
    r = random.Random(4)
    urls = URLS + ["".join(r.choice(["http", "://", "/", "example", ".", "org", "com", "en/1", "fr/", "de/", "es/", "?", "#", "A"]) for _ in range(r.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, None, "x"), (None, "http://a.org/", "y")], PAGES)
    got = url_verdicts(df, URL_RULES).collect()
    assert len(got) == len(urls) + 2
    for g in got:
        if g["page_id"] is not None:
            assert tuple(g)[1:] == plain(urls[g["page_id"]], URL_RULES)
    assert rows(url_verdicts(spark.createDataFrame([], PAGES), URL_RULES)) == []


def test_globs_over_many_words():
    rules = [(f"h{i}.net", f"/a*{i}/b?c", "block") for i in range(40)] + [("*.net", "/**/z", "allow"), ("x.net", "", "allow")]
    automaton = Automaton(rules)
    assert automaton.words > 4
    r = random.Random(5)
    cases = [(r.choice(["h3.net", "w.h7.net", "x.net", "q.x.net", "net", "a.net"]), r.choice(["", "/", "/a/b", "/axx3/bqcrest", "/a7/b/c", "/a7/bxc", "/p/q/z1", "/z", "/a/3/b.c"])) for _ in range(300)]
    won = automaton.winners([b"\xfe." + h.encode() + b"\xff" + p.encode() for h, p in cases])

    def fits(host, path, h, p):
        tail = re.escape(p).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        own = fnmatch.translate(h)
        below = re.compile(r"(.*\.)?" + re.escape(h).replace(r"\*", ".*") + r"\Z")
        return (re.match(own, host) or below.match(host)) and re.match(tail, path)

    for (host, path), w in zip(cases, won.tolist(), strict=True):
        good = [i for i, (h, p, _) in enumerate(rules) if fits(host, path, h, p)]
        best = max(good, key=lambda i: (len(rules[i][0] + rules[i][1]), -i), default=-1)
        assert w == best, (host, path, rules[w], rules[best])
