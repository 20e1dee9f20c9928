"""URL filter: rules on host and path first, else logistic regression on hashed character n-grams.

The labelled URL table is made of word families: names of things that a crawl keeps, names of
things that it leaves out, and words and suffixes that say nothing. A third of each family's
words is never trained on: hosts made of them measure what the model makes of unseen hosts,
and set the threshold.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, in_arrow, table

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: (host + path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Word families of the labelled table: what a host or path is about.
BLOCKED = {
    "gambling": "casino casinos poker bet bets betting jackpot roulette slots lottery gamble gambling blackjack wager bingo".split(),
    "adult": "adult xxx porn sexy cams webcam escort nude erotic hookup milf fetish".split(),
    "pills": "pills pill meds pharmacy viagra cialis cheapmeds tramadol steroids dieting slimming".split(),
    "spam": "spam linkfarm seo backlinks clickbait click ads adserver popup tracker affiliate farm".split(),
    "fraud": "freemoney payday loans getrich crypto-win winner prize replica cracked warez keygen torrent".split(),
}
ALLOWED = {
    "learning": "library university college school academy science physics history museum archive lectures dictionary encyclopedia research".split(),
    "news": "news daily post times journal weather gazette tribune radio press magazine herald chronicle".split(),
    "home": "garden recipes cooking kitchen family travel hiking cycling books stories music birds knitting furniture pets".split(),
    "work": "github docs developer software engineering linkedin jobs careers office tools manual forum wiki support".split(),
    "public": "hospital clinic health city council government parliament police court library-card transport railway charity church".split(),
}
#: Words that hosts of both kinds hold.
NEUTRAL = "best online my the web world top new get go first one real euro portal central hub point zone group house land star blue red fast smart".split()
SUFFIXES = "com net org info io co.uk de fr es it nl com.br ru pl eu us site online shop xyz test dev edu gov in jp me biz".split()
PREFIXES = ("", "", "", "www.", "www.", "m.", "blog.", "en.", "shop.", "app.")
#: Paths that hosts of both kinds hold; {w} is a word of the host's kind, {n} a number.
PATHS = ("", "/", "/index.html", "/about", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/p/{n}", "/article/{n}/spring", "/{w}", "/{w}/{n}", "/a/{w}.html", "/2024/05/{w}-{n}")
#: Rows of the table of each kind and fold; the rows of unseen words are a third as many.
ROWS, SEED = 6000, 17
DIM, SIZES = 1 << 18, (3, 4, 5)
#: Of the validation rows to allow, the share that may be blocked: it sets the threshold.
FALSE_BLOCKS = 0.02
DIGITS = str.maketrans("0123456789", "0000000000")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host with A-Z lower-cased; both empty if url is null or has no ://."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].translate(UPPER_TO_LOWER), rest[cut:end]


def url_parts(url: Column) -> tuple[Column, Column]:
    """split_url as columns."""
    at = F.locate("://", url)
    rest = F.substring_index(F.substring_index(F.when(at > 0, F.substr(url, at + 3)).otherwise(""), "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(F.substr(rest, F.char_length(host) + 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict): the rule's host or a subdomain of it, and a
    path that starts with the rule's. Rules of one length: the one whose text sorts first; the same rule twice: block wins."""
    out = None
    for rule, verdict in sorted(set(rules), key=lambda r: (-len(r[0]), r[0], r[1] != "block")):
        own, slash, prefix = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + prefix))
        got = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(text: str, field: str, dim: int = DIM) -> list[int]:
    """Hashed character n-grams of one field, ends marked; all digits count alike."""
    raw, tag = f"^{text.translate(DIGITS)}$".encode("utf-8", "surrogatepass"), zlib.crc32(field.encode())
    return sorted({zlib.crc32(raw[i : i + n], tag) % dim for n in SIZES for i in range(len(raw) - n + 1)})


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    dim: int
    #: A URL is blocked where its probability is this or more.
    block_from: float = 0.5

    def part(self, text: str, field: str) -> float:
        g = grams(text, field, self.dim)
        return float(self.weights[g].sum() / max(1.0, len(g)) ** 0.5)

    def probability(self, host: str, path: str) -> float:
        """That the URL is to be blocked."""
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.part(host, "host") + self.part(path, "path"), -500, 500))))


def _families(kind: dict[str, list[str]], unseen: bool) -> list[str]:
    """Every third word of each family is unseen in training; words that hold an unseen one are too."""
    held = [w for words in kind.values() for w in words[2::3]]
    rest = [w for words in kind.values() for k, w in enumerate(words) if k % 3 != 2 and not any(h in w or w in h for h in held)]
    return held if unseen else rest


def labelled(unseen: bool = False, rows: int = ROWS, seed: int = SEED) -> list[tuple[str, int]]:
    """The labelled table: (url, 1 block or 0 allow); unseen: of the words that training leaves out."""
    rnd, out = random.Random(f"{seed} {unseen}"), []
    for kind, label in ((BLOCKED, 1), (ALLOWED, 0)):
        words = _families(kind, unseen)
        for _ in range(rows):
            w, other = rnd.choice(words), rnd.choice(words)
            parts = rnd.choice(([w], [w, rnd.choice(NEUTRAL)], [rnd.choice(NEUTRAL), w], [w, other], [rnd.choice(NEUTRAL), w, rnd.choice(NEUTRAL)]))
            host = rnd.choice(PREFIXES) + rnd.choice(("-", "", ".")).join(parts) + "." + rnd.choice(SUFFIXES)
            path = rnd.choice(PATHS).format(w=other, n=rnd.randrange(1, 10 ** rnd.randrange(1, 7)))
            if rnd.random() < 0.15:  # what the host is about shows in the path only
                host = f"{rnd.choice(PREFIXES)}{rnd.choice(NEUTRAL)}{rnd.choice(('-', ''))}{rnd.choice(NEUTRAL)}.{rnd.choice(SUFFIXES)}"
                path = f"/{other}/{rnd.randrange(10**4)}"
            out.append((f"https://{host}{path}", label))
    # hosts that say nothing are to be allowed
    for _ in range(rows // 2):
        host = rnd.choice(PREFIXES) + rnd.choice(("-", "")).join(rnd.sample(NEUTRAL, rnd.choice((1, 2, 2)))) + "." + rnd.choice(SUFFIXES)
        out.append((f"https://{host}{rnd.choice(PATHS).format(w=rnd.choice(NEUTRAL), n=rnd.randrange(10**5))}", 0))
    return out


def _matrix(rows: list[tuple[str, int]], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, of, value = [], [], []
    of_host = lru_cache(None)(grams)
    for k, (url, _) in enumerate(rows):
        for text, field in zip(split_url(url), ("host", "path"), strict=True):
            g = of_host(text, field, dim)
            at += g
            of += [k] * len(g)
            value += [len(g) ** -0.5 if g else 0.0] * len(g)
    return np.array(at, np.int64), np.array(of, np.int64), np.array(value), np.array([v for _, v in rows], np.float64)


def fit(rows: list[tuple[str, int]], validation: list[tuple[str, int]] = (), dim: int = DIM, rounds: int = 150, rate: float = 0.5, l2: float = 2e-5) -> Model:
    """Logistic regression on a small table of (url, 1 block or 0 allow), by Adam over all rows at once.

    validation: rows of other hosts, of which at most FALSE_BLOCKS of those to allow may be blocked;
    the threshold is the least that keeps to this, and 0.5 at least. Without rows nothing is blocked.
    """
    model = Model(np.zeros(dim), 0.0, dim, 0.5)
    if not rows:
        model.bias = -1.0
        return model
    at, of, value, y = _matrix(rows, dim)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both kinds weigh alike
    used, at = np.unique(at, return_inverse=True)
    w, m, v = np.zeros((3, len(used) + 1))  # the last is the bias
    for t in range(1, rounds + 1):
        s = w[-1] + np.bincount(of, w[at] * value, minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y) * share
        grad = np.append(np.bincount(at, g[of] * value, minlength=len(used)), g.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights[used], model.bias = w[:-1], float(w[-1])
    fine = sorted(model.probability(*split_url(u)) for u, label in validation if not label)
    if fine:
        model.block_from = max(0.5, float(np.nextafter(fine[min(len(fine) - 1, int((1 - FALSE_BLOCKS) * len(fine)))], 2)))
    return model


@lru_cache(1)
def default_model() -> Model:
    """The model of the labelled table, with its threshold from half of the unseen words' rows."""
    return fit(labelled(), labelled(unseen=True)[::2])


OUT = "page_id long, host string, path string, rule string, verdict string, p_block double"


def judge(pages: DataFrame, model: Model, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row of pages.

    verdict is the longest fitting rule's, else block where p_block >= the model's block_from, else allow. A null
    url, or one without ://, has an empty host and path, which no rule fits. Repeated rows each
    give a row, null ids stay null, other columns are ignored, empty tables give no rows. Host, path and
    rules are Spark's own expressions; the n-grams' sum is all that Python does.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_host = lru_cache(50_000)(lambda h: model.part(h, "host"))
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            s = np.fromiter((model.bias + of_host(h) + model.part(p, "path") for h, p in zip(hosts, paths, strict=True)), np.float64, len(hosts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))))], names=[*b.schema.names, "p_block"])

    x = in_arrow(x, run, "page_id long, host string, path string, p_block double")
    x = x.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    said = F.coalesce(F.col("ruled.verdict"), F.when(F.col("p_block") >= model.block_from, "block").otherwise("allow"))
    return x.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), said.alias("verdict"), "p_block")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), default_model())
