import math

import pytest
import xxhash

from loomline.llm import url_filter as U
from loomline.llm.queries import op1_url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def rule(host, path):
    best = None
    for text, said in U.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, said)
    return best


def grams(host, path):
    out = []
    for tag, text in (("h", host), ("p", path)):
        text = f"^{text}$"
        for n in U.GRAMS:
            for i in range(len(text) - n + 1):
                seed = 42
                for part in (f"{tag}{n}", *text[i : i + n]):
                    seed = xxhash.xxh64_intdigest(part.encode(), seed)
                out.append((seed - (1 << 64) if seed >> 63 else seed) % U.BUCKETS)
    return out


def vector(url):
    v = {}
    for b in grams(*parts(url)):
        v[b] = v.get(b, 0) + 1.0
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {b: x / norm for b, x in v.items()}


@pytest.fixture(scope="module")
def model():
    rows = [(vector(u), y) for u, y in U.LABELLED]
    w, bias = {}, 0.0
    for _ in range(U.STEPS):
        off = [y - 1 / (1 + math.exp(-(bias + sum(w.get(b, 0) * x for b, x in v.items())))) for v, y in rows]
        w = {b: x * (1 - U.RATE * U.RIDGE) for b, x in w.items()}
        for (v, _), g in zip(rows, off):
            for b, x in v.items():
                w[b] = w.get(b, 0) + U.RATE * g * x
        bias += U.RATE / len(rows) * sum(off)
    return w, bias


def test_matches_brute_force(spark, sf, model):
    w, bias = model
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = op1_url_filter(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = parts(pages[r["page_id"]])
        fits = rule(host, path)
        s = 1 / (1 + math.exp(-(bias + sum(w.get(b, 0) * x for b, x in vector(pages[r["page_id"]]).items()))))
        assert (r["host"], r["path"], r["rule"]) == (host, path, fits and fits[0])
        assert abs(r["score"] - s) < 1e-6
        assert r["verdict"] == (fits[1] if fits else "block" if s >= 0.5 else "allow")


#: URLs of hosts that the labelled table doesn't hold.
HELD_OUT = {
    1: """http://cheapviagra4you.com/order https://www.casino-royale-bonus.net/free-spins https://hotsex-webcam.com/live http://pharmacy-discount-pills.biz/buy
    https://best-payday-loans-online.com/apply http://xxx-tube-videos.net/hot https://pokerbonus-codes.com/signup https://slots4free.club/jackpot
    http://escort-agency-girls.com/city https://hot-singles-dating.ru/xxx http://replica-handbags-sale.com/watches https://betting-odds-live.bet/football
    http://porn-gallery.xxx/teen https://free-keygen-download.ru/crack.exe https://lottery-prize-claim.top/winner http://adult-chatroom.biz/sex
    https://university.example.com/xxx/porn/casino http://onlinepills.ru/cheap-pills https://earn-money-fast.xyz/free-money http://click-ads-tracker.top/click.php?aff=1""".split(),
    0: """https://github.com/apache/spark https://www.nytimes.com/2024/03/01/world/europe/story.html https://www.bbc.co.uk/news/science-environment-123 https://docs.python.org/3/library/index.html
    https://en.wikipedia.org/wiki/Apache_Spark https://www.sueddeutsche.de/politik https://www.harvard.edu/about https://www.mozilla.org/en-US/firefox
    https://www.weather.gov/forecast https://www.nobelprize.org/prizes/physics https://www.ucl.ac.uk/library https://hadoop.apache.org/docs/current
    https://www.bl.uk/collection-items https://www.arte.tv/fr/videos https://cooking-with-maria.com/recipes/pasta https://www.schule-am-park.de/kontakt
    https://riverdale-clinic.org/services https://www.zeit.de/wissen https://trail-running-blog.net/2020/05/gear https://city-of-springfield.gov/parks""".split(),
}


def test_labelled_and_held_out(spark):
    rows = [(u, y) for u, y in U.LABELLED] + [(u, y) for y, urls in HELD_OUT.items() for u in urls]
    got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string"), rules=()).collect()}
    right = [(got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows)]
    n = len(U.LABELLED)
    print("labelled", sum(right[:n]) / n, "held out", sum(right[n:]) / 40, [rows[i] for i in range(n, n + 40) if not right[i]])
    assert sum(right[:n]) >= 0.99 * n
    assert sum(right[n:]) >= 0.95 * 40
    assert all(right[n + 20 + i] for i in range(5))  # github, nytimes, bbc, python, wikipedia


def test_edges(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.COM/en/7/x", "x://A.B.com/en/?q#f", "a://com/en/", "a://xcom/en/", "a://u@É.net/de/8", "a://b://c/d", "a://example.net/de/8", "a://", "a://h" + "/é" * 20000, "a://h\n/p\nq?x"]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)] + [(None, "a://h/", None, None)] * 2, "page_id long, url string, host string, said int")
    got = U.judge(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path = parts(urls[r["page_id"]])
            fits = rule(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, fits and fits[0])
    assert U.judge(df.limit(0)).count() == 0
