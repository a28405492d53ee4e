"""URL filters: rules by longest match, then host word segmentation and multinomial naive Bayes.

A unigram model of words (counted over the parts of host labels and path segments that separators part, and over path
words, with a small prior list, but never over the whole labels that it splits) splits concatenated host labels by Viterbi. A multinomial naive Bayes over the words of host and path learns allow and block from the pages
that the rules decide, and judges the pages that no rule fits. Both word tables are whole: they stay in Spark, and labels and tokens are joined to them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, materialise, only

#: Letters of the longest word; the labels of a legal host have at most 63.
LONGEST = 64
#: Common host words with prior counts, so that usual compounds split before any data are seen.
PRIOR = {w: 50 for w in "ads ad track tracker click clicks banner casino poker bet win free cheap deal deals shop store buy sale pills adult porn sex xxx dating loan credit news blog forum wiki mail web www cdn static img media video music game games download online site page home my the best top world daily health travel food tech data cloud app mobile".split()}
_PART = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")

Rule = tuple[str, str, str]


def parse_rules(lines: list[str]) -> list[Rule]:
    """'block com/en/' becomes ('block', 'com', '/en/')."""
    out = []
    for line in lines:
        verdict, _, rest = line.strip().partition(" ")
        host, slash, path = rest.partition("/")
        out.append((verdict, host, slash + path))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = re.search("[/?#]", rest)
    cut = m.start() if m else len(rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    m = re.search("[?#]", tail)
    return host, tail[: m.start()] if m else tail


class RuleBook:
    """Rules by host; a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) or None. Length counts the rule's characters; of equals the first in text order wins."""
        best = None
        at = 0
        while True:
            suffix = host[at:]
            for p, verdict in self.by_host.get(suffix, ()):
                if path.startswith(p):
                    key = (-len(suffix + p), suffix + p, verdict)
                    best = key if best is None or key < best else best
            at = host.find(".", at) + 1
            if not at:
                return best and (best[1], best[2])


def parts(text: str) -> list[str]:
    """Runs of letters, digits or other characters, lower-cased."""
    return _PART.findall(text.lower())


@dataclass
class Segmenter:
    """Unigram Viterbi over words; an unknown piece of n characters costs as much as a word of 10^-n probability."""

    counts: dict[str, int]
    total: int = 0  # of all words, where counts holds only those that a label can use

    def __post_init__(self):
        self.total = self.total or sum(self.counts.values()) or 1
        self.cost = {w: -math.log(n / (self.total + 1)) for w, n in self.counts.items()}
        self.longest = max(map(len, self.cost), default=1)

    def split(self, label: str) -> list[str]:
        n = len(label)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        unknown = math.log(self.total + 1) + 2
        piece, start = math.inf, 0  # the cheapest split that ends in an unknown piece, and where that begins
        for i in range(1, n + 1):
            # An unknown piece may be of any length; growing it costs a fixed price for each character.
            if best[i - 1] + unknown < piece:
                piece, start = best[i - 1] + unknown, i - 1
            piece += math.log(10)
            for j in range(max(0, i - self.longest), i):
                c = self.cost.get(label[j:i])
                if c is not None and best[j] + c < best[i]:
                    best[i], back[i] = best[j] + c, j
            if piece < best[i]:
                best[i], back[i] = piece, start
        words = []
        while n > 0:
            words.append(label[back[n] : n])
            n = back[n]
        return words[::-1]


def _words(text: str) -> list[str]:
    """Words of a host label or path segment that separators part: the letters of each of its fields."""
    return [w for field_ in re.split(r"[\W_]+", text) for w in parts(field_) if not w.isdigit() and len(w) <= LONGEST]


def word_counts(pages: DataFrame, url_col: str) -> DataFrame:
    """w and n: the distinct host labels and path segments that hold the word as a part, and the prior's counts.

    A label of one field is what is to be split, so it is no evidence that it is a word: it counts nothing, neither as a
    label nor as a path segment of its own. What a separator parts ('casino-win') counts in labels and paths alike.
    Distinct texts count, not pages, so that a code in every path ('/en/') doesn't become likely inside of labels.
    """

    def run(batches):
        for b in batches:
            seen: dict[tuple[str, bool], tuple[bool, list[str]]] = {}
            for u in b.column(0).to_pylist():
                host, path = split_url(u)
                for text, in_host in [(t, True) for t in host.split(".")] + [(t, False) for t in path.lower().split("/")]:
                    if text and (text, in_host) not in seen:
                        lone = sum(any(not w.isdigit() for w in parts(f)) for f in re.split(r"[\W_]+", text)) < 2
                        seen[text, in_host] = lone, _words(text)
            rows = [(t, in_host, lone, words) for (t, in_host), (lone, words) in seen.items() if words]
            yield pa.RecordBatch.from_pydict(
                {"text": [r[0] for r in rows], "label": [r[1] and r[2] for r in rows], "lone": [r[2] for r in rows], "words": [r[3] for r in rows]},
                pa.schema([("text", pa.string()), ("label", pa.bool_()), ("lone", pa.bool_()), ("words", pa.list_(pa.string()))]),
            )

    texts = only(pages, url_col).mapInArrow(run, "text string, label boolean, lone boolean, words array<string>")
    texts = texts.groupBy("text").agg(F.bool_or("label").alias("label"), F.first("lone").alias("lone"), F.first("words").alias("words"))
    words = texts.select("label", "lone", F.explode("words").alias("w"))
    seen = words.groupBy("w").agg(F.count_if(~F.col("lone")).alias("parted"), F.count_if(F.col("lone")).alias("alone"), F.bool_or("label").alias("label"))
    n = F.col("parted") + F.when(F.col("label"), 0).otherwise(F.col("alone"))
    prior = pages.sparkSession.createDataFrame(list(PRIOR.items()), "w string, n long")
    return seen.select("w", n.alias("n")).where("n > 0").unionByName(prior).groupBy("w").agg(F.sum("n").alias("n"))


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """words of each distinct label and their tokens ('h:' before, numbers as '#'), parted by spaces.

    Each label meets the counts of its own substrings by a join, so no task or driver holds the word table.
    """
    total = words.agg(F.sum("n")).first()[0]

    def pieces(batches):
        for b in batches:
            owners, found = [], []
            for label in b.column(0).to_pylist():
                own = set() if label.isdigit() else {label[i:j] for i in range(len(label)) for j in range(i + 1, min(len(label), i + LONGEST) + 1)}
                owners += [label] * len(own)
                found += own
                if len(found) > 100_000:
                    yield pa.RecordBatch.from_pydict({"label": owners, "w": found})
                    owners, found = [], []
            yield pa.RecordBatch.from_pydict({"label": owners, "w": found}, pa.schema([("label", pa.string()), ("w", pa.string())]))

    def split(batches):
        for b in batches:
            out = []
            for label, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.append([label] if label.isdigit() else Segmenter({k["w"]: k["n"] for k in known or ()}, total).split(label))
            tokens = [" ".join("h:#" if w.isdigit() else "h:" + w for w in ws) for ws in out]
            yield pa.RecordBatch.from_pydict({"label": b.column(0), "words": [" ".join(ws) for ws in out], "tokens": tokens}, pa.schema([("label", pa.string()), ("words", pa.string()), ("tokens", pa.string())]))

    hits = labels.mapInArrow(pieces, "label string, w string").join(words, "w").groupBy("label").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    return labels.join(hits, "label", "left").select("label", "known").mapInArrow(split, "label string, words string, tokens string")


def _each(tokens: str) -> Column:
    """The tokens of a column, one row for each; none for ''."""
    return F.explode(F.filter(F.split(tokens, " "), lambda t: t != "")).alias("t")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_score (log odds; null where a rule decides), host_words.

    A null URL, or one without '://', has an empty host and path; as any page that no rule fits it gets the verdict of
    naive Bayes, which is allow at even odds or if no rule decided any page. Repeated rows give a row each; an empty
    table gives none; other columns are not looked at.
    """
    book = RuleBook(rules)
    kind = kind_of(pages, id_col)

    def run(batches):
        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                rule, verdict = book.judge(host, path) or (None, None)
                rows.append((host, path, rule, verdict, " ".join(parts(host)), " ".join("p:#" if w.isdigit() else "p:" + w for w in parts(path))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in columns]], ["id", "host", "path", "rule", "verdict", "labels", "path_tokens"])

    parsed = only(pages, id_col, url_col).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, labels string, path_tokens string")
    decided = [F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")]
    # Words are counted and scored once for each distinct host and path; pages only join the sums.
    hosts = materialise(parsed.groupBy("labels").agg(*decided), "hosts")
    paths = materialise(parsed.groupBy("path_tokens").agg(*decided), "paths")
    label = hosts.select("labels", "allow", "block", F.posexplode(F.split("labels", " ")).alias("pos", "label")).where("label <> ''")
    parted = segment(label.select("label").distinct(), materialise(word_counts(pages, url_col), "words"))
    in_order = F.sort_array(F.collect_list(F.struct("pos", "words", "tokens")))
    joined = label.join(parted, "label").groupBy("labels").agg(F.first("allow").alias("allow"), F.first("block").alias("block"), in_order.alias("x"))
    hosts = materialise(joined.select("labels", "allow", "block", *[F.array_join(f"x.{c}", " ").alias(c) for c in ("words", "tokens")]), "host-words")
    seen = hosts.select("allow", "block", _each("tokens")).unionByName(paths.select("allow", "block", _each("path_tokens")))
    counts = materialise(seen.groupBy("t").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).where("allow + block > 0"), "word-verdicts")
    sums = counts.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("allow", "block")]).first()
    known = paths.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("allow", "block")]).first()
    places = sums["n"] + 1  # one for words never seen
    odds = F.ln((F.col("block") + 1) / (sums["block"] + places)) - F.ln((F.col("allow") + 1) / (sums["allow"] + places))
    other = math.log(1 / (sums["block"] + places)) - math.log(1 / (sums["allow"] + places))
    logs = counts.select("t", odds.alias("odds"))

    def scored(df: DataFrame, key: str, tokens: str, name: str) -> DataFrame:
        each = df.select(F.col(key), _each(tokens)).join(logs, "t", "left")
        # Summed in order of size, so that the last bits don't hang on the order of rows.
        ordered = F.sort_array(F.collect_list(F.coalesce("odds", F.lit(other))))
        return each.groupBy(key).agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x).alias(name))

    out = parsed.join(hosts.select("labels", "words"), "labels", "left").join(scored(hosts, "labels", "tokens", "host_score"), "labels", "left")
    out = out.join(scored(paths, "path_tokens", "path_tokens", "path_score"), "path_tokens", "left")
    score = F.lit(math.log((known["block"] + 1) / (known["allow"] + 1))) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    out = out.withColumn("block_score", F.when(F.col("verdict").isNull(), score))
    verdict = F.coalesce("verdict", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score", F.coalesce("words", F.lit("")).alias("host_words"))
