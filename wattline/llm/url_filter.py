"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The labelled URL table: hosts and paths of sites to block (1) and to allow (0), written for this library.
BLOCKED = """
http://cheap-pills.example/buy http://best-casino.example/bonus http://win-money-now.example/slots http://spam-farm.example/728 http://free-pills-online.example/order
http://online-casino-bonus.example/play http://replica-watches.example/sale http://hot-singles.example/meet http://payday-loans-fast.example/apply http://xxx-videos.example/watch
http://adult-cams.example/live http://poker-bets.example/jackpot http://cheap-viagra.example/pills http://link-farm.example/links http://seo-spam.example/backlinks
http://click-bait-news.example/you-wont-believe http://free-download-crack.example/keygen http://warez-torrents.example/full http://get-rich-quick.example/cash http://lottery-winner.example/claim
http://weight-loss-miracle.example/diet-pills http://discount-meds.example/no-prescription http://bet-spin-win.example/casino http://escort-ads.example/girls http://fake-ids.example/order
http://phish-login.example/verify-account http://malware-host.example/setup.exe http://doorway-pages.example/spam http://spam-blog.example/spam-post http://cheap-tabs.example/pharmacy
http://porn-tube.example/video http://casino-farm.example/free-spins http://crypto-doubler.example/invest http://pills-shop.example/cheap http://auto-spam.example/farm
http://ads.pixel-serve.example/click http://track.adnet.example/pixel.gif http://m.ad-banner.example/pop http://popunder-ads.example/redirect http://adserver.click-through.example/banner
http://live-betting-odds.example/bet http://slots-jackpot.example/spin http://free-bingo-bonus.example/join http://roulette-online.example/vegas http://sport-bets-win.example/odds
http://nude-webcams.example/girls http://sexy-dates.example/chat http://hardcore-tube.example/xxx http://erotic-videos.example/free http://hot-escorts.example/city
http://generic-viagra-pharmacy.example/buy http://no-prescription-pills.example/order http://slim-fast-pills.example/diet http://steroids-cheap.example/shop http://canadian-meds-discount.example/viagra
http://fake-rolex-watches.example/replica http://luxury-replica-bags.example/cheap http://buy-fake-passport.example/id http://counterfeit-shop.example/sale http://cheap-essay-writers.example/order
http://instant-cash-loans.example/payday http://double-your-bitcoin.example/profit http://make-money-fast.example/join http://forex-easy-profit.example/signal http://free-gift-cards.example/claim
http://secure-bank-login.example/verify http://account-update-verify.example/login.php http://paypa1-support.example/confirm http://free-iphone-winner.example/claim http://your-prize-waiting.example/win
http://keygen-serial-crack.example/download http://torrent-free-movies.example/full http://cracked-software.example/setup.exe http://mp3-download-free.example/warez http://codec-update.example/install.exe
http://buy-backlinks-cheap.example/seo http://auto-blog-spam.example/post http://link-exchange-seo.example/links http://shocking-trick.example/doctors-hate http://spam-directory.example/submit
""".split()
ALLOWED = """
http://www.city-library.example/catalogue http://news.daily-post.example/world/2019 http://blog.gardening.example/roses http://en.wiki.example/wiki/History http://docs.project.example/guide
http://www.university.example/physics/course http://m.weather.example/forecast http://museum.example/exhibits http://www.school.example/lessons http://recipes.example/bread
http://journal.science.example/articles/12 http://www.parliament.example/debates http://blog.travel.example/es/533 http://forum.python.example/questions http://www.hospital.example/contact
http://radio.example/programmes http://shop.books.example/novels http://static.maps.example/en/671 http://www.football.example/results http://m.cinema.example/en/474.html
http://blog.history.example/en/960 http://open-data.example/sets http://www.orchestra.example/concerts http://kids.zoo.example/animals http://www.theatre.example/plays
http://law.example/cases/1998 http://www.astronomy.example/planets http://gov.example/services http://blog.cooking.example/soup http://www.hiking.example/trails
http://chess.example/openings http://language.example/grammar http://www.railway.example/timetable http://art.example/painters http://www.bakery.example/about
http://www.city-council.example/minutes http://blog.birdwatching.example/owls http://physics.institute.example/papers/quantum http://www.daily-herald.example/politics/election http://news.valley-times.example/local
http://docs.database.example/manual/joins http://wiki.mathematics.example/wiki/Theorem http://www.botanic-garden.example/plants http://archive.letters.example/1890 http://m.news-radio.example/morning
http://www.high-school.example/timetable http://college.example/admissions http://forum.woodwork.example/thread/42 http://blog.photography.example/lenses http://shop.tools.example/hammers
http://www.ministry.example/health/report http://statistics.example/population http://court.example/judgments/2004 http://www.embassy.example/visa http://tax.example/forms
http://en.encyclopedia.example/wiki/Volcano http://dictionary.example/words http://poetry.example/sonnets http://www.film-festival.example/programme http://music.conservatory.example/lessons
http://www.cycling-club.example/routes http://swimming.example/results/2012 http://www.rugby.example/fixtures http://blog.running.example/marathon http://www.sailing.example/races
http://kitchen.example/recipes/pasta http://www.vineyard.example/visits http://farm.example/vegetables http://www.cheese-maker.example/cheddar http://blog.baking.example/sourdough
http://www.airport.example/departures http://bus.example/lines/7 http://ferry.example/crossings http://www.campsite.example/map http://hotel.lakes.example/rooms
http://astronomy.club.example/telescopes http://geology.example/rocks/granite http://www.weather-office.example/warnings http://open-source.example/releases http://lectures.example/biology/cells
""".split()
#: Default rules of the query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    own = rule[1].lower()
    return ((host == own) | host.endswith("." + own)) & path.startswith(rule[2])


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The fitting rule that is longest (host and path together; of equals the first in order of text) and its verdict, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r), reverse=True):
        name = F.when(fits(host, path, r), F.lit(r[1].lower() + r[2])).otherwise(name)
        verdict = F.when(fits(host, path, r), F.lit(r[0])).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """Character n-grams of host and path, each marked with where it is from."""
    def pieces(mark: str, text: Column, n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    sides = ("h", F.concat(F.lit("."), host, F.lit("."))), ("p", F.lower(path))
    return F.concat(*[pieces(mark, text, n) for mark, text in sides for n in sizes])


def train(spark: SparkSession, labelled: DataFrame, features: int = 1 << 14):
    """A model of (url, label) rows, label 1 for block."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = labelled.select(grams(host, path).alias("grams"), F.col("label").cast("double").alias("label"))
    stages = [HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features"), LogisticRegression(regParam=0.01, maxIter=100)]
    return Pipeline(stages=stages).fit(rows)


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int").coalesce(1)


def judge(spark: SparkSession, pages: DataFrame, *, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) per row: the longest fitting rule's verdict, else the model's.

    Null urls and those without :// have an empty host and path, which no rule fits, and are judged by the model
    on no n-grams but the host's bounds. Rules are a short list that becomes one expression. Repeated rows
    keep their rows; very long urls are judged whole. Extra columns are ignored.
    """
    model = train(spark, labelled if labelled is not None else labelled_urls(spark))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    p = vector_to_array("probability")[1]
    own = F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return model.transform(rows).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), p.alias("p_block"))
