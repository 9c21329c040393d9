"""URL filters: rules for hosts and paths, and logistic regression on hashed character n-grams.

Everything is DataFrame or SQL functions. The model is fitted in its dual form: one row gathers the
small labelled table's examples, a higher-order function runs the gradient steps on their Gram
matrix, and the example weights are folded into one weight per bucket, kept as a literal array.
Scoring hashes a URL's n-grams in place, without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# Rules of this list, as host and path prefix with a verdict.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

# The labelled table's own examples, hosts and paths; the first are unwanted, the others welcome.
UNWANTED_HOSTS = (
    "discountviagra.com", "order-cialis-online.net", "cheapmedsnow.biz", "pharmacy-without-prescription.ru", "weightlosspills.info", "buytramadol.top",
    "pillstore24.com", "genericdrugs-express.net", "slimfastmiracle.xyz", "royalcasinoclub.com", "lucky-slots.net", "bestonlinecasinos.bet",
    "vegaspokerroom.com", "jackpotspins.club", "sportsbetting-tips.win", "livebets365.com", "freebetoffers.net", "roulette-king.xyz",
    "pokerchipsfree.top", "hotporntube.com", "freexxxclips.net", "sexcamslive.com", "nudegirls-chat.ru", "adultdatingsite.biz",
    "hot-milfs.xxx", "eroticmassage-escorts.com", "escortgirls-city.net", "camsex4free.com", "pornstarvideos.xxx", "hookuptonight.date",
    "sexyteens-gallery.ru", "adultfriendchat.com", "replicawatches-outlet.com", "fake-rolex.shop", "cheap-louisvuitton-bags.net", "nikeoutlet-sale.top",
    "quickpaydayloan.com", "instantcashadvance.net", "badcreditloans-now.info", "makemoneyfast.biz", "earn-cash-home.xyz", "getrichquick-system.com",
    "crypto-doubler.top", "freebitcoin-giveaway.net", "forexprofitbot.xyz", "win-iphone-prize.club", "lottery-winner-claim.info", "congratulations-giftcard.top",
    "free-ringtones-download.net", "warez-crackz.ru", "keygen-serials.net", "crackedsoftware-full.xyz", "torrentmovies-free.top", "pirated-games.click",
    "clicktracker-ads.com", "popunder-network.net", "adserver-banner.biz", "spam-backlinks.info", "seo-linkfarm.net", "buyfollowers-cheap.com",
    "bulkemail-blaster.biz", "traffic-exchange-hits.top", "phishing-login-verify.xyz", "account-suspended-alert.top", "paypa1-secure-update.ru", "free-antivirus-scan-now.click",
    "miracle-diet-secret.club", "penis-enlarge-pills.com", "casino-bonus-codes.org", "xxx-movies-archive.org", "online-pharmacy-store.com", "bet-on-football.net",
)
UNWANTED_PATHS = (
    "/buy-viagra-online", "/casino/bonus/free-spins", "/xxx/videos/hot", "/porn/teen", "/cheap-pills?ref=1", "/slots/jackpot/play-now",
    "/adult/cams/live", "/win/prize/claim.php", "/click.php?aff=77", "/ads/banner/track", "/loans/payday/apply", "/escorts/city/girls",
    "/download/crack/keygen.exe", "/free-money", "/bet/odds/signup-bonus", "/sex/chat", "/replica/watches/sale", "/lottery/winner",
)
WELCOME_HOSTS = (
    "en.wiktionary.org", "commons.wikimedia.org", "www.britannica.com", "www.gutenberg.org", "archive.org", "www.nature.com", "www.science.org", "arxiv.org",
    "www.theguardian.com", "www.reuters.com", "apnews.com", "www.lemonde.fr", "www.spiegel.de", "elpais.com", "www.corriere.it", "www.nhk.or.jp",
    "www.washingtonpost.com", "www.economist.com", "www.npr.org", "www.pbs.org", "www.cbc.ca", "www.abc.net.au", "www.dw.com", "www.lefigaro.fr",
    "stackoverflow.com", "gitlab.com", "bitbucket.org", "docs.oracle.com", "developer.mozilla.org", "kubernetes.io", "www.postgresql.org", "numpy.org",
    "pandas.pydata.org", "www.rust-lang.org", "go.dev", "nodejs.org", "www.debian.org", "www.kernel.org", "www.gnu.org", "learn.microsoft.com",
    "www.mit.edu", "www.stanford.edu", "www.ox.ac.uk", "www.cam.ac.uk", "ethz.ch", "www.tum.de", "www.sorbonne.fr", "www.uba.ar",
    "www.nasa.gov", "www.nih.gov", "www.cdc.gov", "www.who.int", "www.un.org", "europa.eu", "www.gov.uk", "www.bundestag.de",
    "www.nps.gov", "www.loc.gov", "www.metmuseum.org", "www.louvre.fr", "www.rijksmuseum.nl", "www.moma.org", "www.si.edu", "www.nhm.ac.uk",
    "www.allrecipes.com", "www.bonappetit.com", "www.seriouseats.com", "www.kingarthurbaking.com", "www.gardenersworld.com", "www.rhs.org.uk", "www.lonelyplanet.com", "www.nationalgeographic.com",
    "www.ikea.com", "www.lego.com", "www.bosch.com", "www.toyota.com", "www.deutschebahn.com", "www.sncf-connect.com", "www.lufthansa.com", "www.airfrance.fr",
    "www.springer.com", "www.elsevier.com", "www.jstor.org", "pubmed.ncbi.nlm.nih.gov", "scholar.archive.org", "www.plos.org", "www.cambridge.org", "academic.oup.com",
    "www.fifa.com", "www.olympics.com", "www.uefa.com", "www.chess.com", "www.imdb.com", "www.goodreads.com", "www.rottentomatoes.com", "www.discogs.com",
    "blog.cloudflare.com", "www.mayoclinic.org", "www.khanacademy.org", "www.coursera.org", "www.edx.org", "www.duolingo.com", "www.ted.com", "www.scientificamerican.com",
    "smithfamilydentist.com", "oakhill-school.org", "riverside-library.org", "mountain-hiking-club.de", "bakery-lindner.at", "stadtwerke-ulm.de", "ville-de-nantes.fr", "ayuntamiento-sevilla.es",
    "anna-photography.net", "brown-law-office.com", "greenvalleyfarm.com", "community-orchestra.org", "localhistorysociety.org.uk", "carpentry-workshop.net", "village-theatre.org", "birdwatching-notes.net",
)
WELCOME_PATHS = (
    "/", "/about", "/news/2021/05/12/local-election-results", "/wiki/History_of_science", "/articles/climate-report", "/docs/getting-started", "/en/latest/api.html",
    "/questions/231767/what-does-yield-do", "/research/papers/1234", "/recipes/apple-pie", "/events/calendar", "/en/12", "/fr/340", "/es/87", "/de/455",
    "/blog/2019/03/release-notes", "/contact", "/library/catalog?page=2", "/world/europe", "/health/conditions", "/tutorial/index.html", "/products/42", "/museum/collection", "/courses/math",
)


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: each host with two paths of its kind."""
    out = []
    for label, hosts, paths in ((1, UNWANTED_HOSTS, UNWANTED_PATHS), (0, WELCOME_HOSTS, WELCOME_PATHS)):
        out += [(f"https://{host}{paths[(5 * i + 7 * k) % len(paths)]}", label) for i, host in enumerate(hosts) for k in (0, 1)]
    return out


#: At most MOST_LABELS rows of (url, 1 for unwanted).
LABELLED = tuple(labelled_urls())
MOST_LABELS = 1000
#: Buckets of the hashed n-grams, their lengths, gradient steps, step size and ridge penalty.
BUCKETS, GRAMS, STEPS, RATE, RIDGE = 4096, (3, 4, 5), 150, 0.5, 0.002


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path; both empty where there is none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null. Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(reversed(rules), key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(tag: str, chars: Column, n: int) -> Column:
    last = F.size(chars) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), *[F.get(chars, i + k) for k in range(n)]), F.lit(BUCKETS)).cast("int"))


def buckets_of(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of ``^host$`` and ``^path$``, with repeats."""
    out = []
    for tag, text in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        out.append(let(chars, _all_grams(tag)))
    return F.concat(*out)


def _all_grams(tag: str):
    return lambda chars: F.concat(*[_grams(f"{tag}{n}", chars, n) for n in GRAMS])


def fit(spark: SparkSession, labelled=LABELLED) -> list[float]:
    """Weights of the BUCKETS buckets and the bias, from at most MOST_LABELS (url, label) rows."""
    if len(labelled) > MOST_LABELS:
        raise ValueError(f"the labelled table holds more than {MOST_LABELS} rows")
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double")
    grams = rows.select("i", F.explode(buckets_of(*host_path(F.col("url")))).alias("b")).groupBy("i", "b").agg(F.count("*").cast("double").alias("x"))
    norm = grams.groupBy("i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    grams = grams.join(norm, "i").select("i", "b", (F.col("x") / F.col("norm")).alias("x")).cache()
    other = grams.select(F.col("i").alias("j"), "b", F.col("x").alias("z"))
    gram = grams.join(other, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    line = gram.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("r"))
    n = len(labelled)
    full = F.expr(f"transform(sequence(0, {n - 1}), j -> coalesce(element_at(map_from_entries(r), j), 0D))")
    line = rows.join(line, "i").select("i", "y", full.alias("k"))
    one = line.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "y", "k"))), lambda e: F.struct(e["y"], e["k"])).alias("e"))
    step = f"""aggregate(sequence(1, {STEPS}),
      named_struct('a', array_repeat(0D, {n}), 'b', 0D),
      (s, t) -> transform(array(transform(e, q -> q.y - 1D / (1D + exp(-(s.b + aggregate(zip_with(s.a, q.k, (u, v) -> u * v), 0D, (m, v) -> m + v)))))),
        g -> named_struct('a', zip_with(s.a, g, (u, v) -> u * {1 - RATE * RIDGE}D + {RATE}D * v), 'b', s.b + {RATE / n}D * aggregate(g, 0D, (m, v) -> m + v)))[0]) AS s"""
    state = one.selectExpr(step).select("s.a", "s.b").cache()
    alpha = state.select(F.posexplode("a").alias("i", "alpha"))
    weights = grams.join(alpha, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("alpha")).alias("w")).collect()
    bias = state.first()["b"]
    out = [0.0] * BUCKETS + [bias]
    for b, w in weights:
        out[b] = w
    grams.unpersist(), state.unpersist()
    return out


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that a URL is unwanted; n-gram counts are scaled to unit length."""
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")
    zero = F.struct(F.lit(-1).alias("b"), F.lit(0.0).alias("n"), F.lit(0.0).alias("q"), F.lit(0.0).alias("dot"))

    def counted(s: Column, b: Column) -> Column:
        n = F.when(s["b"] == b, s["n"] + 1.0).otherwise(1.0)
        return F.struct(b.alias("b"), n.alias("n"), (s["q"] + 2.0 * n - 1.0).alias("q"), (s["dot"] + F.get(table, b)).alias("dot"))

    margin = F.aggregate(F.array_sort(buckets_of(host, path)), zero, counted, lambda s: s["dot"] / F.sqrt(F.greatest(s["q"], F.lit(1.0))))
    return 1.0 / (1.0 + F.exp(-(margin + F.lit(float(weights[-1])))))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A null url, or one without ``://``, has an empty host and path and is judged by the method like
    any other. Repeated rows are judged alike; an empty table gives no rows.
    """
    weights = fit(pages.sparkSession, labelled)
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    scored = rows.select("*", rule.alias("rule"), said.alias("said"), score(F.col("host"), F.col("path"), weights).alias("score"))
    method = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
