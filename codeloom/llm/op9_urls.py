"""URL filtering: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Rules go first, the longest that fits wins. Other URLs are judged by a logistic regression on the share
of each hashed character n-gram (3 to 5) of host and path, trained with Spark's own estimator on a small labelled
table. Features and scores are column expressions: an n-gram's bucket is a polynomial of its code points, and
a score is a fold over the string with the 16,384 weights as one literal array. One pass, no shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and, like
any shorter than five characters, scores 0 (allowed); repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
_SCALE = 20.0
_PRIME = 1_000_003

#: (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# Labels: names of the kind that public block lists hold, by theme, and of ordinary sites. Written for this table, not
# taken from any input; hosts and paths around them are dealt to both labels alike, so that only names tell.
UNWANTED = """
onlinecasino royalcasino casinobonus vegas-casino jackpotcity megaslots slotmachines luckyslots pokerstake pokerbonus roulettewheel
bettingodds sportsbets betmaster bets365 winjackpot winbigmoney bingobonus lottowinner lotterywin
viagrastore genericviagra cialis-online pharmapills dietpills pillstore buypills pillsdirect weightlosspills cheapmeds canadianpharmacy
steroidshop miraclecure hairlosscure detoxtea
paydayloans fastcashloan instantloan badcreditloans easymoney getrichquick moneydoubler forexprofit bitcoindoubler cryptogiveaway
binaryoptions investscam
adultvideos adultdating adultchat adultcams sexcams livesex sexshop pornvideos freeporn porntube xxxmovies xxx-cams hotgirls hotsingles
nudepics escortservice hookupnow
popupads adserver adsclick clickads bannerads adnetwork-popunder trackclicks clicktracker trackingpixel adtracker affiliatespam
spamhost spammers bulkspam linkfarm seolinks backlinkshop contentfarm buyfollowers cheaplikes fakereviews clickfraud
replicawatches fakerolex cheaphandbags discountreplica freegiftcards freeiphone claimprize surveyprize freestuff cheapdeals freecoupons
warezdownload crackedsoftware keygens serialcrack torrentpirate movietorrents malwaredrop spywarescan phishinglogin verifyaccount
secure-login-update accountsuspended virusalert
""".split()
WANTED = """
statelibrary nationallibrary citylibrary artmuseum museumofhistory university college highschool kindergarten polytechnic academy
institute sciencedaily physicsreview chemistryworld biologynotes mathforum historytoday archaeology astronomy geography encyclopedia
dictionary wikipages gutenbergbooks bookstore bookreview poetryfoundation literature theatre operahouse orchestra cinema filmfestival
photography gallery architecture newspaper dailynews morningpost eveningherald thetimes tribune gazette chronicle observer guardian
weatherservice trafficreport timetable railway trains airport airlines travelguide hotels hostels camping hiking cycling mountaineering
sailing swimming football basketball athletics chessclub marathon cookbook recipes bakery restaurant vegetables gardening beekeeping
farming forestry birdwatching wildlife nationalpark oceanography environment climate energy engineering electronics robotics
softwarefoundation programming pythondocs javadocs linuxkernel opensource documentation tutorials developerforum database statistics
economics lawreview parliament government cityhall ministry embassy policestation firebrigade hospital clinic dentist nursing
medicalschool publichealth nutrition pharmacology insurance accounting bankingnews stockexchange realestate furniture carpentry
knitting quilting pottery instruments guitars violin choir jazz folkmusic radiostation television podcast community volunteers charity
foundation church cathedral monastery genealogy familytree heritage castle village riverside northshore
anthropology philosophy theology translation nonprofit notebook devops cloudbase webmail
archive preprints scholar citations openaccess repository datasets benchmark compiler kernelnews packages mirror download-center
heartclinic diabetes vaccines healthline redcross emergency ambulance pharmacist
elpais elmundo diezeit derspiegel corriere larepubblica dagbladet aftonbladet asahi tageblatt abendblatt
amazonia marketplace groceries supermarket fashion clothing shoes jewelry cosmetics perfume toys babycare petshop hardwarestore
gardencenter electrician plumber painter locksmith moving storage recycling water electricity gasworks internet telephone mobile
postoffice parcels logistics shipping freight harbor ferry subway tramway buslines taxi carrental motorbike bicycles parking
school-district elementary campus alumni scholarship lectures courses seminar conference proceedings journals publisher printing
vikings ancient medieval renaissance modernart sculpture ballet theater comedy festival carnival circus zoo aquarium planetarium
worldradio washington london paris berlin madrid tokyo sydney toronto stockholm helsinki warsaw
musicstream playlist lyrics karaoke boardgames puzzles crossword sudoku quiz trivia
tennis rugby cricket hockey skiing surfing climbing yoga fitness gymnastics rowing archery fencing horse-riding dogs cats
pizza sushi noodles coffee teahouse winery brewery cheese chocolate honey bread breakfast lunch dinner vegan kitchen
notary court justice police-union senate council mayor embassy-office customs passport election census treasury pension
volcano earthquake glacier desert rainforest coral whales butterflies insects mushrooms flowers trees soils rivers lakes
quantum neutron laser optics polymer genome protein neuron algebra geometry calculus topology logic statistics-lab proof
""".split()
#: Share of unwanted pages that scores reckon with, whatever the table's own share is. Set on names that the table doesn't have, so that
#: of ordinary ones less are mistaken than of unwanted ones.
PRIOR = 0.45
_FRONTS = ("", "www.", "shop.", "news.", "en.", "portal.")
_TOPS = ("com", "org", "net", "info", "eu", "co.uk", "de", "io")
_PATHS = ("/", "", "/{}", "/index.html", "/item/{}", "/2019/04/post-{}", "/view/{}.html", "/en/{}/", "/contact.php", "/a/b/{}", "/archive/{}.html", "/fr/page{}", "/es/{}")


def labelled() -> list[tuple[str, str, float]]:
    """The labelled table (host, path, label): each name under several hosts and paths, so only names tell."""
    return [
        (f"{_FRONTS[(i + k) % 6]}{name}.{_TOPS[(i // 2 + 3 * k) % 8]}", _PATHS[(5 * i + 7 * k) % 13].format((7919 * i + 104729 * k) % 99991), label)
        for label, names in ((1.0, UNWANTED), (0.0, WANTED))
        for i, name in enumerate(names)
        for k in range(4)
    ]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does."""
    out = F.lit(None)
    for verdict, h, p in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _buckets(codes: Column, n: int) -> Column:
    """Buckets of a text's n-grams, from its code points alone."""

    def bucket(i: Column) -> Column:
        h = F.lit(n).cast("long")
        for k in range(n):
            h = F.pmod(h * 1009 + F.element_at(codes, i + k), F.lit(_PRIME))
        return F.pmod(F.pmod(h * 40503, F.lit(_PRIME)), F.lit(BUCKETS)).cast("int")

    return F.transform(F.sequence(F.lit(1), F.size(codes) - n + 1), bucket)


def features(host: Column, path: Column) -> Column:
    """The buckets of all n-grams of host and path, repeats included."""
    whole = F.concat(host, path)
    codes = F.transform(F.split(F.concat(F.lit("^"), whole, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    grams = let(codes, lambda c: F.concat(*[_buckets(c, n) for n in GRAMS]))
    return F.when(F.length(whole) >= max(GRAMS), grams).otherwise(F.array().cast("array<int>"))


@cache
def _trained(app: str, spark: SparkSession) -> tuple[tuple[float, ...], float]:
    table = spark.createDataFrame(labelled(), "host string, path string, label double").coalesce(1)
    grams = cut(table.select("label", features(F.col("host"), F.col("path")).cast("array<string>").alias("grams")))
    counted = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "grams", "counts").transform(grams)
    # The share of each bucket, times a fixed scale.
    shares = Normalizer(p=1.0, inputCol="counts", outputCol="shares").transform(counted)
    ready = ElementwiseProduct(scalingVec=Vectors.dense([_SCALE] * BUCKETS), inputCol="shares", outputCol="features").transform(shares)
    model = LogisticRegression(regParam=0.0003, maxIter=100, standardization=False).fit(ready.select("label", "features"))
    shift = log(PRIOR / (1 - PRIOR)) - log(len(UNWANTED) / len(WANTED))
    return tuple(float(x) for x in model.coefficients), float(model.intercept) + shift


def unwanted(spark: SparkSession, found: Column) -> Column:
    """Probability that a page of these features is unwanted."""
    weights, bias = _trained(spark.sparkContext.applicationId, spark)
    table = F.split(F.lit(",".join(f"{w:.7g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b))
    z = F.lit(bias) + total * _SCALE / F.greatest(F.size(found), F.lit(1))
    return F.when(F.size(found) > 0, 1 / (1 + F.exp(-z))).otherwise(0.0)


def judge(pages: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict, probability)`` for every row."""
    host, path = parts(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    found = split.withColumn("fit", rule_of(F.col("host"), F.col("path")))
    found = found.withColumn("grams", features(F.col("host"), F.col("path")))
    found = found.withColumn("probability", unwanted(pages.sparkSession, F.col("grams")))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "probability")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
