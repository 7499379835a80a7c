"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of key characters that is long enough and mixes kinds of characters.
The forest looks at its length, the transitions between kinds of characters, how much of
it dictionary words cover, what it has of a path, and the words and marks around it. It
is trained from labelled findings.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalweave.llm.common import as_bytes, map_texts, worker_value

CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_.@:-])[A-Za-z0-9+/_.@:-]{12,}(?:={1,2}(?![A-Za-z0-9+/_.@:=-]))?")
#: A colon between a name and its value; those of an address (://) and of a time are not.
COLON = re.compile(rb"(?<!-\d\dT\d\d)(?<!-\d\dT\d\d:\d\d):(?!//)")
AROUND = 48
#: Words that name a secret, words that name other codes, and common parts of words. Fixed values.
SECRET_WORDS = frozenset("token secret password passwd pwd apikey api_key key auth authorization bearer credential credentials private access_key secret_key client_secret signature".split())
CODE_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid guid version revision id isbn doi url href src file path image build order invoice phone card iban number".split())
DICTIONARY = tuple(
    "the and ing ion tion ent ment for ough with that this from have will your page file index main test data user name home work time line text word list read write open close image about contact release change config setting service server client system local public static build index default example value number update create delete value email mail http https www com org net html json yaml xml".split()
)
WORDS_IN = re.compile("|".join(sorted(set(DICTIONARY), key=len, reverse=True)))
WORD = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*")
#: The words of a name like AccountKey.
CASES = re.compile("[A-Z][a-z]+")
KINDS = np.zeros(256, np.int8)
KINDS[48:58], KINDS[65:91], KINDS[97:123] = 1, 2, 3
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "changes", "letter_changes", "distinct", "entropy", "hex", "dictionary", "vowels",
    "slashes", "dots", "dashes", "at_sign", "extension", "secret_word", "code_word", "assigned", "quoted", "uuid", "repeats",
)


def _key_length(run: bytes) -> int:
    """Bytes of a run without marks at its end if it is a candidate, else 0."""
    value = run.rstrip(b".:-")
    if len(value) < 12:
        return 0
    kinds = KINDS[np.frombuffer(value, np.uint8)]
    digits, letters = (kinds == 1).any(), (kinds >= 2).any()
    mixed = (kinds == 2).sum() >= 3 and (kinds == 3).sum() >= 3 and len(value) >= 20
    return len(value) if digits and letters or mixed else 0


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of candidates: at least 12 key characters with a digit and a letter, or 20 with both cases.

    A run with colons gives its parts that are candidates; it is one itself if none of them is.
    """
    found = []
    for match in CANDIDATE.finditer(text):
        start, run = match.start(), match[0]
        parts = []
        if b":" in run:
            at = 0
            for part in COLON.split(run):
                if size := _key_length(part):
                    parts.append((start + at, start + at + size))
                at += len(part) + 1
        if not parts and (size := _key_length(run)):
            parts.append((start, start + size))
        found += parts
    return found


def features(text: bytes, start: int, end: int) -> list[float]:
    value = text[start:end]
    codes = np.frombuffer(value, np.uint8)
    kinds = KINDS[codes]
    n = len(codes)
    counts = np.bincount(codes, minlength=256)
    share = counts[counts > 0] / n
    changes = (kinds[1:] != kinds[:-1]).sum()
    low = value.lower().decode("ascii", "replace")
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    near = [w.decode() for w in WORD.findall(before)[-3:]]
    parts = {p.lower() for w in near for p in (w, *w.split("_"), *CASES.findall(w))}
    lead = before.rstrip(b" \t\"'`(<[{")
    letters = kinds >= 2
    vowels = sum(low.count(c) for c in "aeiou")
    return [
        n,
        (kinds == 1).mean(),
        (kinds == 2).mean(),
        (kinds == 3).mean(),
        (kinds == 0).mean(),
        changes / max(n - 1, 1),
        (letters[1:] != letters[:-1]).sum() / max(n - 1, 1),
        len(share) / n,
        float(-(share * np.log2(share)).sum()),
        float(re.fullmatch("[0-9a-f]+", low) is not None),
        sum(len(m) for m in WORDS_IN.findall(low)) / n,
        vowels / max(int(letters.sum()), 1),
        value.count(b"/"),
        value.count(b"."),
        value.count(b"-"),
        float(b"@" in value),
        float(re.search(r"\.[a-z]{2,4}$", low) is not None),
        float(bool(parts & SECRET_WORDS)),
        float(bool(parts & CODE_WORDS)),
        float(lead.endswith((b"=", b":", b"=>")) or lead.lower().endswith(b"bearer")),
        float(before[-1:] in (b'"', b"'", b"`") and after[:1] == before[-1:]),
        float(re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low) is not None),
        float(counts.max() / n),
    ]


@dataclass(frozen=True)
class Training:
    """``findings``: labelled findings of each kind that are used, at most; the rest sizes the forest."""

    findings: int = 3000
    trees: int = 40
    depth: int = 8
    seed: int = 7


class Forest:
    """Random forest of binary trees over numeric features, as arrays."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, settings: Training = Training()):
        draw = np.random.default_rng(settings.seed)
        self.trees = []
        tried = max(2, int(np.sqrt(points.shape[1])) + 1)
        for _ in range(settings.trees):
            rows = draw.integers(0, len(points), len(points))
            feature, limit, child, share = [], [], [], []

            def grow(x: np.ndarray, y: np.ndarray, depth: int) -> int:
                at = len(feature)
                feature.append(-1), limit.append(0.0), child.append((0, 0)), share.append(float(y.mean()))
                if depth == 0 or len(y) < 8 or y.min() == y.max():
                    return at
                best = (np.inf, -1, 0.0)
                for f in draw.choice(x.shape[1], tried, replace=False):
                    values = np.unique(x[:, f])
                    for cut in np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 12))) if len(values) > 1 else ():
                        left = x[:, f] <= cut
                        a, b = y[left], y[~left]
                        if len(a) and len(b):
                            p, q = a.mean(), b.mean()
                            best = min(best, (len(a) * p * (1 - p) + len(b) * q * (1 - q), int(f), float(cut)))
                if best[1] < 0:
                    return at
                left = x[:, best[1]] <= best[2]
                feature[at], limit[at] = best[1], best[2]
                child[at] = (grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))
                return at

            grow(points[rows], labels[rows].astype(float), settings.depth)
            self.trees.append((np.array(feature), np.array(limit), np.array(child), np.array(share)))

    def probability(self, points: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each point falls into."""
        total = np.zeros(len(points))
        for feature, limit, child, share in self.trees:
            at = np.zeros(len(points), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                right = points[i, feature[at[i]]] > limit[at[i]]
                at[i] = child[at[i], right.astype(int)]
            total += share[at]
        return total / max(len(self.trees), 1)


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, 1 if a secret): findings of known kinds in contexts of known kinds, ``n`` of each label."""
    draw = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "an the er ing tion re ou le de en ch un ga as es mi ra do con per".split()

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(draw.choice(alphabet) for _ in range(draw.randint(low, high)))

    def word() -> str:
        return "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))

    def plain() -> str:
        return " ".join(word() for _ in range(draw.randint(2, 6)))

    secrets = [
        lambda: some(hexes, 32, 32), lambda: some(hexes, 40, 40), lambda: some(hexes, 64, 64), lambda: some(alnum, 20, 48),
        lambda: "AKIA" + some(alnum[:26] + "0123456789", 16, 16), lambda: "ghp_" + some(alnum, 36, 36), lambda: "sk-" + some(alnum, 40, 48),
        lambda: some(alnum + "+/", 40, 44) + "=", lambda: f"eyJ{some(alnum, 20, 30)}.{some(alnum, 40, 60)}.{some(alnum, 30, 43)}", lambda: some(hexes, 40, 40).upper(),
    ]
    others = [
        lambda: f"{word()}.{draw.randint(1, 99)}@mail{draw.randint(1, 9)}.example.com", lambda: f"{word()}/{word()}/{word()}{draw.randint(1, 99)}.html",
        lambda: f"https://www.{word()}.com/{word()}-{draw.randint(1, 9999)}", lambda: f"{word()}_{word()}_{draw.randint(1, 99)}{word()}",
        lambda: f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 99)}-beta{draw.randint(1, 9)}x86", lambda: "x" * draw.randint(12, 30) + "1",
        lambda: f"{some(hexes, 8, 8)}-{some(hexes, 4, 4)}-{some(hexes, 4, 4)}-{some(hexes, 4, 4)}-{some(hexes, 12, 12)}", lambda: f"{word().title()}{word().title()}{word().title()}{word().title()}Handler{draw.randint(1, 9)}",
        lambda: f"20{draw.randint(10, 29)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}T{draw.randint(10, 23)}:{draw.randint(10, 59)}:{draw.randint(10, 59)}Z", lambda: some(hexes, 40, 40),
    ]
    keys = sorted(SECRET_WORDS)
    codes = sorted(CODE_WORDS)
    found = []
    for label in (1, 0):
        for _ in range(n):
            kind = draw.randrange(10)
            value = (secrets if label else others)[kind]()
            key = draw.choice(keys)
            key = draw.choice((key, key.upper(), key.title(), f"{word()}_{key}"))
            if label:
                form = draw.choice(('{k} = "{v}"', "{k}={v}", '"{k}": "{v}"', "{k}: {v}", "{k} '{v}'", "{k} {v}"))
            elif kind == 9:
                key, form = draw.choice(codes), draw.choice(("{k} {v}", "{k}: {v}", "{k}={v}"))
            else:
                key, form = draw.choice((word(), word(), draw.choice(codes))), draw.choice(("{k} {v}", "{k}: {v}", '"{v}"', "{v}", "{k} ({v})", "{k}={v}"))
            body = form.format(k=key, v=value)
            text = f"{plain()} {body} {plain()}".encode()
            at = text.index(value.encode())
            found.append((text, at, at + len(value), label))
    return found


def train(findings: Iterable[tuple[bytes, int, int, int]], settings: Training = Training()) -> Forest:
    """A forest of labelled findings (text, start byte, end byte, 1 if a secret); both labels must occur."""
    rows = list(findings)
    labels = np.array([r[3] for r in rows])
    if not {0, 1} <= set(labels.tolist()):
        raise ValueError("labelled findings of both kinds are needed")
    return Forest(np.array([features(t, a, b) for t, a, b, _ in rows], np.float64), labels, settings)


def corpus_findings(docs: DataFrame, text: str = "text", settings: Training = Training()) -> list[tuple[bytes, int, int, int]]:
    """A bounded sample of findings of the corpus, labelled by their form.

    A quoted value assigned to a name that holds a secret word is a secret; a candidate with an address
    sign, a path or a file ending, without such a word before it, is none. Others are not used.
    """

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        place = {name: i for i, name in enumerate(FEATURES)}
        for content in as_bytes(columns[0]):
            rows = []
            for a, b in candidates(content or b""):
                x = features(content, a, b)
                named = x[place["secret_word"]] > 0
                if named and x[place["assigned"]] and x[place["quoted"]]:
                    label = 1
                elif not named and (x[place["at_sign"]] or x[place["slashes"]] or x[place["extension"]]):
                    label = 0
                else:
                    continue
                from_ = max(0, a - AROUND)
                rows.append({"context": content[from_ : b + AROUND], "start": a - from_, "end": b - from_, "label": label})
            out.append(rows)
        kind = pa.list_(pa.struct([("context", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32())]))
        return [pa.array(out, kind)]

    found = map_texts(docs, [], [F.col(f"`{text}`").cast("string")], "findings array<struct<context:binary,start:int,end:int,label:int>>", work)
    rows = found.select(F.inline("findings")).distinct()
    # One pass finds the sample of both labels; a task sends on as many rows of a label as are wanted at most.
    order = Window.partitionBy("label").orderBy(F.xxhash64("context"), "start", "end")
    drawn = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= settings.findings).drop("_rank")
    return [(bytes(r.context), r.start, r.end, r.label) for r in drawn.orderBy(F.desc("label"), F.xxhash64("context"), "start", "end").toLocalIterator()]


FINDINGS = "findings array<struct<start:long,end:long,score:double>>"


def _judged(contents: Sequence[bytes | None], forest: Forest, threshold: float) -> list[list[tuple[int, int, float]]]:
    """Byte spans and scores of the findings of each text."""
    spans = [(row, a, b) for row, content in enumerate(contents) for a, b in candidates(content or b"")]
    found: list[list[tuple[int, int, float]]] = [[] for _ in contents]
    for start in range(0, len(spans), 4096):
        part = spans[start : start + 4096]
        scores = forest.probability(np.array([features(contents[row], a, b) for row, a, b in part], np.float64))
        for (row, a, b), score in zip(part, scores):
            if score >= threshold:
                found[row].append((a, b, float(score)))
    return found


def scan(docs: DataFrame, forest: Forest, keep: Sequence[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` of each row and its findings: start and end in code points of the whole text, and the score.

    A null or empty text has none; a long text is scanned whole. Row-local: repeated rows stay, an
    empty table gives an empty one, and a kept column of the name ``findings`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest.trees)

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        judge = worker_value(shared, _rebuilt)
        out = []
        contents = as_bytes(columns[0])
        for content, spans in zip(contents, _judged(contents, judge, threshold)):
            rows, at, chars = [], 0, 0
            for a, b, score in spans:
                chars += len(content[at:a].decode("utf-8", "replace"))
                rows.append({"start": chars, "end": chars + b - a, "score": score})
                chars, at = chars + b - a, b
            out.append(rows)
        return [pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]

    return map_texts(docs, keep, [F.col(f"`{text}`").cast("string")], FINDINGS, work)


def _rebuilt(trees: list) -> Forest:
    forest = Forest.__new__(Forest)
    forest.trees = trees
    return forest


def redact(docs: DataFrame, forest: Forest, text: str = "text", mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each finding replaced by ``mask``; rows without findings, null texts too, stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(forest.trees)
    columns = docs.columns
    plain = docs.toDF(*[f"_d{i}" for i in range(len(columns))])
    place = columns.index(text)

    def work(arrays: list[pa.Array]) -> list[pa.Array]:
        contents = as_bytes(arrays[0])
        out = []
        for content, spans in zip(contents, _judged(contents, worker_value(shared, _rebuilt), threshold)):
            if spans:
                parts, at = [], 0
                for a, b, _ in spans:
                    parts += [content[at:a], mask.encode()]
                    at = b
                content = b"".join([*parts, content[at:]])
            out.append(content)
        return [pa.array(out, pa.binary()).cast(pa.string())]

    done = map_texts(plain, plain.columns, [F.col(f"_d{place}").cast("string")], "_new string", work)
    return done.select(*[F.col("_new" if i == place else f"_d{i}").alias(c) for i, c in enumerate(columns)])
