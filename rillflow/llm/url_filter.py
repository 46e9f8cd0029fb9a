"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for what no rule fits.

Everything is DataFrame and SQL functions. A url's n-grams of 3 to 5 characters, of its host and of its path apart, are hashed (CRC-32) into
`BUCKETS` buckets; its features are the distinct buckets, each
worth one over the root of their number in the host or the path. The labelled table is small (at
most `max_rows` rows are fitted, those with the least hash if there are more), so the fit is one row's expression: full gradient
steps over two arrays of lists, the buckets of each example and the examples of each bucket. Weights are rounded to
millionths and go to the scan of the urls as a literal of `BUCKETS` numbers, whatever the size of either table.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case, the path what follows up to `?`, `#` or the end. A
rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins, of equally long ones the one of the longer
host, then the first in the list.

Defined cases: a null url and one without `://` have an empty host and path, which no rule fits, and only the bias judges them; empty paths fit
no rule; long urls are read whole in linear time; labelled rows with a null url or label are left out, a url labelled both ways counts as both, and without any
labelled rows everything is allowed; rows are judged one by one, so repeats and null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 1 << 14, (3, 4, 5)
#: Gradient steps, their length, the share of the last step that is added to each, and the shrinking of weights.
STEPS, RATE, MOMENTUM, DECAY = 150, 2.0, 0.9, 0.9995
MILLIONTHS = 1_000_000

#: The rules, longest first wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A small labelled table: hosts, or addresses, of kinds that corpora leave out, and ordinary ones. Hosts stand with one of the paths, in turn.
BLOCKED = """casino-royal.example.com www.online-casino.example.org m.casino-slots.example.net blog.casino-bonus.example.com casino.example.org poker-win.example.net www.win-poker.example.com
jackpot-win.example.org m.jackpot-slots.example.com free-slots.example.net www.slots-free.example.org free-bets.example.org m.sports-bets.example.com blog.bets-today.example.net best-bets.example.com
betting-tips.example.org www.bets.example.net cheap-pills.example.org www.pills-online.example.com m.pharma-pills.example.net blog.pills-shop.example.org diet-pills.example.com viagra-cheap.example.net
www.cheap-viagra.example.org cheap-meds.example.com m.meds-cheap.example.net adult-video.example.com www.adult-chat.example.org m.adult-cams.example.net blog.adult-dates.example.com adult.example.net
adult-xxx.example.org m.adult-zone.example.com www.adult-site.example.net xxx-movies.example.com www.hot-xxx.example.net m.xxx-cams.example.org sex-dates.example.com www.sex-cams.example.net nude-cams.example.org m.hot-nude.example.com escort-city.example.net
www.escort-girls.example.org spam-links.example.com www.spam-mail.example.net m.spam-seo.example.org blog.spam-list.example.com link-spam.example.net link-farm.example.org www.link-farm.example.com
m.seo-farm.example.net blog.content-farm.example.org ads-server.example.com www.ads-click.example.net m.click-ads.example.org blog.popup-ads.example.com banner-ads.example.org ads.example.net
track-users.example.org www.track-pixel.example.com m.click-track.example.net ad-track.example.com free-money.example.net www.money-free.example.org win-prize.example.com m.prize-win.example.net
payday-loan.example.org www.fast-loan.example.com m.loan-cash.example.net warez-crack.example.com www.crack-serial.example.org keygen-warez.example.net phish-login.example.com www.login-phish.example.org
replica-watch.example.net diet-miracle.example.com https://offers.example.org/casino/bonus http://www.portal.example.com/free-bets/win https://m.market.example.net/cheap-pills/order
http://go.example.com/adult/xxx https://blog.city.example.org/ads/click""".split()
ALLOWED = """www.library.example.org museum.example.com blog.gardening.example.net m.weather.example.org news.example.com www.university.example.net recipes.example.org history.example.com
m.football.example.net www.chemistry.example.org travel.example.com forum.example.net docs.example.org blog.astronomy.example.com www.hospital.example.net parks.example.org music.example.com
www.theatre.example.net m.radio.example.org bridge.example.com blog.river.example.org www.stone.example.net nation.example.com m.other.example.org winter.example.net www.thing.example.com
therapy.example.org blog.northern.example.net m.station.example.com father.example.org www.ration.example.net motion.example.com thread.example.org m.hour.example.net blog.tender.example.org
www.onset.example.com court.example.net m.ether.example.org www.author.example.com blog.estate.example.net thebes.example.org www.hinder.example.net m.shells.example.com tiles.example.org
www.council.example.net school.example.com m.bakery.example.org blog.sailing.example.net atlas.example.com www.poetry.example.org law.example.net m.farmers.example.com bikes.example.org
www.trains.example.net blog.linguist.example.com coast.example.org m.painter.example.net www.physics.example.com birds.example.org choir.example.net www.archive.example.com m.geology.example.org
blog.knitting.example.net energy.example.com parliament.example.org www.cinema.example.net m.chess.example.com lakes.example.org blog.coffee.example.com www.health.example.net stamps.example.org
m.clocks.example.com bees.example.net www.castle.example.org islands.example.com m.orchard.example.net www.green-valley.example.org m.book-club.example.com blog.night-sky.example.net
old-town.example.org www.city-maps.example.com open-data.example.net m.folk-songs.example.org www.free-software.example.com wind-farm.example.net www.cheap-travel.example.org race-track.example.com
anchor.example.net blog.basil.example.org m.candle.example.com www.dolphin.example.net elm.example.org blog.fable.example.com m.garnet.example.net
www.harbor.example.org iris.example.com blog.jasmin.example.net m.kettle.example.org www.lantern.example.com meadow.example.net blog.nectar.example.org
m.oak.example.com www.pebble.example.net quartz.example.org blog.raven.example.com m.saddle.example.net www.tundra.example.org umber.example.com
blog.violet.example.net m.willow.example.org www.yarrow.example.com zephyr.example.net blog.amber.example.org m.birch.example.com www.cedar.example.net
delta.example.org blog.ember.example.com m.fern.example.net www.grove.example.org hazel.example.com blog.indigo.example.net m.juniper.example.org
www.kelp.example.com lotus.example.net blog.maple.example.org m.nickel.example.com www.opal.example.net pine.example.org blog.quill.example.com
m.reed.example.net www.sage.example.org thistle.example.com blog.tinder.example.net m.thorn.example.org www.ether.example.com north.example.net
blog.tenth.example.org m.theme.example.com www.onion.example.net nation.example.org blog.heron.example.com m.then.example.net www.shore.example.org
tide.example.com blog.thrush.example.net
art-history.example.net www.field-notes.example.org m.home-cooking.example.com blog.river-walk.example.net deep-sea.example.com www.world-map.example.org m.word-games.example.net data-tables.example.com
tree-house.example.org blog.sea-birds.example.com www.law-review.example.net hill-side.example.org m.high-tide.example.com www.adults-learning.example.org betty.example.net download.example.com
https://www.market.example.com/en/vegetables http://m.city.example.org/fr/mairie https://offers.example.net/de/wohnung http://portal.example.com/es/noticias https://go.example.org/en/rules-of-go""".split()
PATHS = "/en/1 /fr/2/ /de/3.html /en/4.html /es/5 /en/6/ /de/7 /fr/8 /en/9 /es/10/ /de/11/ /en/12 /fr/13.html".split()


def addresses(given: Sequence[str]) -> list[str]:
    return [u if "://" in u else f"https://{u}{PATHS[k % len(PATHS)]}" for k, u in enumerate(given)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small table of this module: url, label (1: block)."""
    return spark.createDataFrame([(u, 1) for u in addresses(BLOCKED)] + [(u, 0) for u in addresses(ALLOWED)], "url string, label int")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path), empty where there is none."""
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def features(host: Column, path: Column) -> Column:
    """array<struct<b:long,c:double>>: the distinct buckets, from 1, of a url's n-grams and their worth, by ascending bucket in the host, then in
    the path. The host begins and ends with a dot here, and a number in the path is a 0."""
    texts = {"h": F.when(host != "", F.concat(F.lit("."), host, F.lit("."))).otherwise(""), "p": F.regexp_replace(F.lower(path), "[0-9]+", "0")}
    hashed = lambda tag: lambda gram: F.crc32(F.concat(F.lit(tag), gram)) % BUCKETS + 1
    halves = []
    for k, t in texts.items():
        grams = [F.transform(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), hashed(k)) for n in SIZES]
        # a list of one list binds the distinct buckets, so that they are made once
        halves.append(F.flatten(F.transform(F.array(F.array_sort(F.array_distinct(F.concat(*grams)))), lambda d: F.transform(d, lambda b: F.struct(b.alias("b"), (F.lit(1.0) / F.sqrt(F.size(d).cast("double"))).alias("c"))))))
    return F.concat(*halves)


@dataclass(frozen=True)
class Model:
    """bias and the weights of all buckets, in millionths."""

    bias: int
    weights: tuple[int, ...]

    def score(self, found: Column) -> Column:
        """Above 0 if the url with these features is likelier one to block. The weights are one literal, made of a text when the plan is optimised."""
        weights = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")
        return F.aggregate(found, F.lit(float(self.bias)), lambda a, f: a + F.element_at(weights, f["b"].cast("int")) * f["c"])


#: State: bias and weights, and those of the step before.
_STEP = """aggregate(sequence(1, {steps}), named_struct('b', 0D, 'p', 0D, 'w', transform(lists, l -> 0D), 'q', transform(lists, l -> 0D)), (s, t) ->
  transform(array(transform(examples, e -> e.y - 1D / (1D + exp(-aggregate(e.f, s.b, (a, x) -> a + element_at(s.w, x.j) * x.c))))), r -> named_struct(
    'b', s.b + {momentum} * (s.b - s.p) + {rate} / greatest(size(examples), 1) * aggregate(r, 0D, (a, x) -> a + x), 'p', s.b,
    'w', transform(lists, (l, k) -> element_at(s.w, k + 1) * {decay} + {momentum} * (element_at(s.w, k + 1) - element_at(s.q, k + 1)) + {rate} / greatest(size(examples), 1) * aggregate(l, 0D, (a, x) -> a + element_at(r, x.i) * x.c)),
    'q', s.w))[0])"""


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_rows: int = 2_000, steps: int = STEPS, rate: float = RATE, momentum: float = MOMENTUM, decay: float = DECAY) -> Model:
    """Logistic regression by full gradient steps. At most max_rows rows are fitted; one row of arrays holds the examples, their features, and the weights."""
    given = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("y")).filter("url is not null and y is not null")
    given = given.orderBy(F.xxhash64("url"), "url", "y").limit(max_rows)
    one = given.select("url", "y", features(*parts(F.col("url"))).alias("f")).agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("found"))
    one = one.withColumn("known", F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda e: F.transform(e["f"], lambda x: x["b"]))))))
    held = one.select(F.posexplode("found").alias("i", "e")).select((F.col("i") + 1).alias("i"), F.inline("e.f")).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("held"))
    rows = held.agg(F.array_sort(F.collect_list(F.struct("b", "held"))).alias("by_bucket")).select(F.transform("by_bucket", lambda x: x["held"]).alias("lists"))
    coded = one.select("known", F.expr("transform(found, e -> struct(e.y as y, transform(e.f, x -> struct(cast(array_position(known, x.b) as int) as j, x.c as c)) as f)) as examples"))
    whole = coded.crossJoin(rows)  # one row each
    fitted = whole.select("known", F.expr(_STEP.format(steps=int(steps), rate=f"{rate!r}D", momentum=f"{momentum!r}D", decay=f"{decay!r}D")).alias("m"))
    done = fitted.select("known", F.round(F.col("m.b") * MILLIONTHS).cast("long").alias("b"), F.transform("m.w", lambda w: F.round(w * MILLIONTHS).cast("int")).alias("w")).first()
    weights = [0] * BUCKETS
    for bucket, w in zip(done["known"] or [], done["w"] or []):
        weights[bucket - 1] = w
    return Model(int(done["b"] or 0), tuple(weights))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The rule that decides, as a struct (rule, action); null where none fits. Rules are tried one by one: a list of up to some hundreds."""
    split = [(action, text, *text.partition("/")[::2]) for action, text in rules]
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, text, h, rest in reversed(sorted(split, key=lambda r: (-len(r[1]), -len(r[2])))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def judged(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row: one scan of two columns, no shuffle."""
    host, path = parts(F.col(url_col))
    read = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("features", F.when(F.col("found").isNull(), features(F.col("host"), F.col("path"))))
    verdict = F.when(F.col("found").isNotNull(), F.col("found.action")).when(model.score(F.col("features")) > 0, "block").otherwise("allow")
    return read.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
