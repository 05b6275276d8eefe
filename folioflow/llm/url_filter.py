"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model learns from a small labelled table of URLs (``LABELLED`` unless another
is given) with FTRL updates on the driver, and is broadcast: its size is fixed by
``BITS``. ``cross_validated`` tells how it does on URLs that it didn't learn from.

Defined results: a null url, or one without ``://``, has an empty host and path;
no rule fits an empty host; the model then judges by its bias,
the log odds of its labels; ports and user
names stay part of the host. Of rules equally long, the first one wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_slices, with_fields
from folioflow.llm.linear import Ftrl, log_odds, mix, row_features, scores_of, sigmoid

#: (host and path, verdict). A rule's host ends at its first slash.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
BITS = 16
PASSES = 8
GRAMS = (3, 4, 5)
#: Gambling, drugs, adult pages, link spam, trackers, loans, pirated files, fakes and fraud, without their scheme.
BLOCKED = """
casino-royal.top/bonus/free-spins?aff=9  www.luckyspin-casino.com/en/slots  blackjack-online.org/play  m.winbig-casino.net/de/jackpot  megawin-slots.vip/spin  pokerstars-bonus.win/register
bet-on-football.info/odds  free-bet-offer.com/claim?ref=a1  blog.sportsbets-tips.net/2021/04/best-odds  online-roulette-win.biz/  jackpot-party.club/en/12  betting-king.io/live/en  www.casino-gratis.es/es/bono
cheap-viagra-online.biz/buy  rx-pills-store.com/order/cialis  www.discount-pills.net/en/cart  no-prescription-meds.ru/xanax  diet-pills-miracle.shop/lose-weight-fast  pharmacy-cheap-meds.top/tramadol  blog.miracle-pill-review.com/en/77
buy-cheap-steroids.cc/shop  weightloss-pills.click/offer  generic-levitra.us/fr/acheter  pillsexpress.to/checkout
free-porn-videos.xxx/watch/81  hot-adult-chat.club/join  xxx-movies.tv/en/category/amateur  www.sexcam-live.com/models  m.adult-dating.net/signup  nude-girls-pics.org/gallery/5  adult-xxx-tube.info/video/123
escort-service.city/de/girls  blog.adult-stories.net/en/9  live-sex-shows.cam/room/4  erotic-webcams.eu/fr/direct  hentai-xxx.moe/manga/66  milf-hookup.date/near-you
ads-server.click/redirect?u=1  track.adnetwork.biz/pixel.gif  adserver.banner-ads.net/serve  clicktrack-media.com/c/9921  popunder-ads.xyz/t  m.ads-delivery.org/en/impression  affiliate-track.link/go?id=77  tracking-pixel.site/p/1
ad-click-tracker.io/click  doublepop-ads.top/show  www.adtrack24.de/de/track  stats-ads-beacon.com/b
link-farm-directory.com/links/page3  seo-spam-links.net/backlinks  www.buy-backlinks.biz/packages  article-spinner-farm.info/en/4512  spamblog-network.org/post/771  free-directory-submit.top/add-url  content-farm-daily.com/top-10-tricks
blog.spam-comments.net/de/88  doorway-pages-seo.xyz/keyword-3  autoblog-farm.club/en/2021/01  guestpost-link-spam.site/offer  keyword-stuffing.us/page/9  www.link-exchange-spam.eu/fr/liens
payday-loan-cash.loan/apply  fast-cash-advance.net/en/now  bad-credit-loans-approved.com/apply  quickloan-today.top/es/prestamo  www.easy-money-online.biz/earn  get-rich-fast.club/secret  bitcoin-doubler.vip/invest  forex-profit-robot.com/signup
crypto-giveaway-elon.live/claim  make-money-home.click/start  binary-options-win.org/trade  instant-payday.cash/de/kredit
cracked-warez.download/keygen.exe  torrent-pirate-seed.bid/movie/2020  free-serial-keys.net/photoshop  www.crack-software.org/en/patch  nulled-scripts.to/plugins  warez-ddl.biz/rapid  game-hacks-cheats.club/download.exe  movies-free-stream.cc/watch-hd
iso-warez-torrents.info/de/spiele  licensekey-generator.top/office  mod-apk-hack.com/unlimited-coins  rip-torrent.me/fr/film
replica-watches-sale.shop/rolex  cheap-replica-bags.net/louis  fake-designer-outlet.com/en/sale  www.replica-sneakers.cn/yeezy  buy-fake-id.cc/order  fake-diploma-online.org/degree  outlet-cheap-handbags.top/de/angebot
secure-paypal-login.verify-account.tk/signin  apple-id-locked.support-team.ml/verify  bank-account-update.ga/login.php  win-free-iphone.click/survey  you-won-prize.club/claim-now  free-gift-cards.top/generator  virus-alert-call.xyz/scan
www.prize-winner-survey.com/es/premio  update-flash-player.download/install.exe  webmail-verify.cf/login  tech-support-alert.online/call  dating-singles-hot.date/fr/rencontre
cheap-pills-direct.com/en/order  pills-and-pharmacy.org/generic  spam-mailer.org/send  linkfarm-spam.com/en/333  the-spam-list.net/fr/2  bulk-email-spam.com/lists  casino-bonus-win.com/en/play  winning-casino.org/fr/jeux  free-bets-today.com/en/1  betsonline.net/en/free
xxxadultmovies.com/en/2  adult-toys-xxx.org/de/4  ads-tracking.com/en/c  trackingads.net/fr/t  click-ads.org/en/55  replica-store.com/en/6  torrents-free.org/en/7  loans-cash-fast.org/de/8  cash-loans.com/en/9  hotgirls-chat.com/en/10  free-spins-slots.com/de/5  porn-tube-free.com/fr/3
viagra-pills.net/en/14  miracle-diet-pills.com/es/15  hacked-accounts.com/en/16  cracks-and-keygens.net/en/17  seo-link-farms.com/de/18  cheapmeds.org/en/19  gamble-online.com/en/20  sexdating.com/de/21  win-prizes-free.com/en/22  jackpot-slots.net/es/23
"""
#: Encyclopedias, schools, papers, shops, town halls, clubs, code and blogs, without their scheme.
ALLOWED = """
en.wikipedia.org/wiki/Botany  de.wikipedia.org/wiki/Hauptseite  www.britannica.com/science/photosynthesis  plato.stanford.edu/entries/kant  www.nature.com/articles/4711  arxiv.org/abs/2101  docs.python.org/3/library/re.html
developer.mozilla.org/en/docs/Web  stackoverflow.com/questions/11227809  github.com/apache/spark/issues/12  www.gnu.org/software/grep/manual  blog.rust-lang.org/2021/05/06  wiki.archlinux.org/title/Installation_guide  www.kernel.org/doc
www.bbc.co.uk/news/world-europe  www.lemonde.fr/fr/planete/article  www.spiegel.de/wissenschaft/mensch  elpais.com/es/cultura/2020  www.theguardian.com/environment/rivers  www.nytimes.com/2019/science  m.reuters.com/article/idUS77  www.zeit.de/de/2020/12
local-herald.net/en/council-meeting  www.harbour-times.org/story/312  evening-post.info/sport/results  www.valley-news.com/en/2021/03/school-opens  gazette-regional.fr/fr/actualites/18  www.tagesblatt.lu/de/kultur
www.university-press.edu/catalog/history  library.college.edu/search-help  www.school-district.org/calendar  math.department.edu/courses/101  www.museum-island.de/de/ausstellung  national-gallery.org.uk/paintings/turner  www.botanic-garden.org/plants/fern
archive.org/details/oldbooks  www.gutenberg.org/ebooks/84  openlibrary.net/works/12  www.city-council.gov/services/water  www.health-ministry.gov/en/vaccines  weather.gov/forecast/north  www.parliament.uk/business/bills  ec.europa.eu/fr/policies
town-hall.info/de/termine  www.fire-brigade.org/contact  tax-office.gov/forms/1040  www.court-records.us/case/88  rathaus-online.de/de/buergerdienste  ayuntamiento.es/es/tramites
kitchen-garden.com/recipes/leek-soup  www.bread-baking.net/sourdough  blog.home-cooking.org/2018/11/apple-cake  cycling-club.org/routes/alps  www.mountain-hikes.net/en/trail/9  chess-federation.org/tournament  www.bird-watching.com/species/heron  knitting-circle.info/patterns/scarf
astronomy-forum.net/thread/551  www.model-trains.de/de/anleitung  photography-notes.com/lens-tests  sailing-school.eu/fr/cours  www.choir-society.org/concerts  gardening-tips.org/en/roses  blog.old-maps.net/en/1750
www.book-store.com/fiction/novels  music-shop.net/guitars/strings  www.furniture-makers.co.uk/tables  bike-repair.org/shop/chains  www.tea-house.cn/green  paper-and-ink.eu/notebooks  hardware-store.com/tools/hammer  www.flower-shop.fr/fr/bouquets
hotel-bellevue.ch/de/zimmer  www.railway-timetable.org/lines/5  airport-info.net/arrivals  travel-notes.com/portugal/lisbon  www.camping-lake.it/en/prices  ferry-lines.gr/schedule
www.hospital-north.org/departments  dentist-practice.com/opening-hours  animal-shelter.net/adopt/dogs  www.red-cross.org/donate-blood  physio-center.de/de/team  www.pharmacy-board.gov/rules
software-notes.io/en/testing  www.data-journal.org/volume/3  m.engineering-blog.com/en/caching  open-hardware.net/boards/rev2  www.statistics-office.gov/tables/4  compiler-notes.org/post/ssa  www.network-guide.info/en/routing  blog.databases.net/fr/index
poetry-review.org/issue/17  www.film-archive.net/en/1932  theatre-group.com/programme  history-podcast.fm/episode/40  www.language-course.es/es/leccion/8  radio-regional.at/de/programm  children-stories.net/en/fox  www.folk-songs.org/lyrics/22
village-church.org/services  www.farmers-market.com/stalls  lake-rowing.de/de/verein  www.fishing-permits.gov/apply  old-bridge-cafe.com/menu  www.bee-keepers.org/en/honey  clockmaker.ch/fr/montres  www.geology-society.org/rocks/basalt
farm-museum.com/en/visit  dairy-farm.net/en/cheese  wind-farm-data.org/tables  www.tree-farm.com/en/4  free-software.com/en/licenses  track-and-field.net/en/results  winter-sports.com/de/langlauf  window-makers.net/en/frames  chapel-choir.com/en/7  cheese-board.net/fr/8  addison-street.com/en/9
winery-tours.net/es/10  train-tracks.org/de/11  betty-bakes.com/en/12  clickable-maps.net/en/13  hotel-adler.com/de/14  cast-iron.net/en/15  download-statistics.org/en/16  the-linen-shop.com/en/17  northern-theatre.net/en/18  other-stories.com/fr/19  weather-station.net/en/20
the-mathematics-page.net/en/21  thermal-baths.com/de/22  anthropology-notes.com/en/23  third-grade-reading.net/en/24  national-stations.com/fr/25  translation-notes.net/en/26  internet-history.com/en/27  heather-and-thyme.net/es/28  education-north.com/en/29  brother-press.net/de/30  thatched-roofs.com/en/31
literary-notes.com/en/32  southern-rivers.net/fr/33  nations-at-rest.com/en/34  ethics-reader.net/en/35  earth-and-stone.com/es/36  leather-work.net/en/37  tension-springs.com/de/38  mother-tongue.net/en/39  motion-pictures-notes.com/fr/40  invention-archive.net/en/41  trading-post-history.com/en/42
apothecary-museum.net/en/43  path-finder.com/en/44  bathing-season.net/de/45  interior-notes.com/en/46  station-master.net/fr/47  health-visitors.com/en/48  threshing-barn.net/en/49  the-herald-north.com/de/50  winds-and-tides.net/en/51  island-bees.com/es/52  ordnance-maps.net/en/53  distant-shores.com/en/54
"""


def _labelled(text: str, label: int) -> tuple[tuple[str, int], ...]:
    return tuple((f"https://{url}", label) for url in text.split())


#: (url, 1 to block or 0 to allow)
LABELLED = _labelled(BLOCKED, 1) + _labelled(ALLOWED, 0)
#: Labels in front of hosts of all sorts.
FIRST_LABELS = ("www", "m", "blog")
#: Parts in front of paths of all sorts: languages.
FIRST_PARTS = ("en", "de", "fr", "es")
THRESHOLD = 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; ASCII letters lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null: one expression over all rules."""
    out = F.lit(None)
    for text, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):  # what is put around the others is asked first
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts between a start and an end sign, one text after another, and where each ends."""
    own = texts.to_pylist()
    flat = np.frombuffer("".join([f"^{t}$" for t in own]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat, np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 2)


def features(hosts: pa.Array, paths: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of each character n-gram of hosts and paths, each a kind of its own."""
    rows, hashed = [], []
    for kind, texts in ((1, hosts), (2, paths)):
        flat, ends = _points(texts)
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        left = ends[row] - np.arange(len(flat))  # characters from here to the text's end
        gram = np.zeros(len(flat), dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            gram = gram[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :]
            if n in GRAMS:
                at = np.flatnonzero(left[: len(gram)] >= n)
                rows.append(row[at])
                hashed.append(mix(gram[at], n, kind, bits))
    return np.concatenate(rows), np.concatenate(hashed)


def split_url(url: str | None) -> tuple[str, str]:
    """The host and path of one url, as the column expressions give them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return lowered, path[:stop]


def _variants(url: str) -> list[str]:
    """The url with each of the usual first labels of a host and, on its bare host, with each of the usual first parts of
    a path, so that these tell the model nothing."""
    scheme, mark, rest = url.partition("://")
    first, dot, bare = rest.partition(".")
    bare = bare if first in FIRST_LABELS else rest
    host, number = bare.partition("/")[0], zlib.crc32(bare.encode()) % 1000
    plain = [f"{scheme}{mark}{host}/{part}/{number}" for part in FIRST_PARTS]
    return [f"{scheme}{mark}{bare}", *[f"{scheme}{mark}{label}.{bare}" for label in FIRST_LABELS], *plain]


def fit(labelled=LABELLED, bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, float, int]:
    """Weights, bias and bits from (url, label) pairs, in an order fixed by a hash."""
    pairs = sorted(((v, label) for url, label in labelled for v in _variants(url)), key=lambda r: (zlib.crc32(r[0].encode()), r))
    hosts, paths = zip(*(split_url(url) for url, _ in pairs), strict=True) if pairs else ((), ())
    made = row_features(*features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()), bits), len(pairs), bits)
    learner = Ftrl(bits, log_odds([label for _, label in pairs]), l1=0.01)
    for _ in range(passes):
        for i, (_, label) in enumerate(pairs):
            at = slice(made.bounds[i], made.bounds[i + 1])
            learner.learn(made.at[at], made.x[at], label)
    return (*learner.weights(), bits)


def model_scores(hosts: pa.Array, paths: pa.Array, model: tuple[np.ndarray, float, int]) -> np.ndarray:
    """The chance to block of each host and path."""
    weights, bias, bits = model
    return sigmoid(scores_of(row_features(*features(hosts, paths, bits), len(hosts), bits), weights, bias))


def cross_validated(labelled=LABELLED, folds: int = 5, threshold: float = THRESHOLD) -> dict[str, float]:
    """Accuracy, and precision and recall of blocking, over folds whose hosts the model hasn't learned from."""
    right = blocked = bad = caught = 0
    fold = {url: zlib.crc32(split_url(url)[0].encode()) % folds for url, _ in labelled}
    for k in range(folds):
        own = [r for r in labelled if fold[r[0]] == k]
        hosts, paths = zip(*(split_url(url) for url, _ in own), strict=True)
        found = model_scores(pa.array(hosts), pa.array(paths), fit([r for r in labelled if fold[r[0]] != k])) >= threshold
        labels = np.array([y for _, y in own], dtype=bool)
        right, blocked, bad, caught = right + int((found == labels).sum()), blocked + int(found.sum()), bad + int(labels.sum()), caught + int((found & labels).sum())
    return {"accuracy": right / len(labelled), "precision": caught / max(1, blocked), "recall": caught / max(1, bad)}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: tuple[np.ndarray, float, int] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, score, verdict) of every row; the score is the model's chance to block."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit())
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scores = model_scores(pc.fill_null(part.column("host"), ""), pc.fill_null(part.column("path"), ""), held.value)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "score"])

    scored = map_slices(parts, run, with_fields(parts.schema.fields, "score double"), text="path")
    scored = scored.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("id", "host", "path", F.col("fit.rule").alias("rule"), "score", F.coalesce("fit.verdict", by_model).alias("verdict"))


def url_report(pages: DataFrame) -> DataFrame:
    """The digest of ``judge`` per page row."""
    return judge(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
