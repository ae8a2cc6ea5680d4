r"""Personal data: fixed patterns, and secrets found by weak supervision.

Base kinds (email, ip, card, phone) are the leftmost, non-overlapping matches of fixed patterns, each found in time linear
in the text. The method adds ``secret``. Candidates are runs of letters, digits and ``+ / _ -`` with a digit, of MIN_RUN
characters or more, and whatever run of MIN_NAMED characters a secret's name and an assignment lead up to (``password=hunter2``), with or
without a digit; none may meet a base span. Seven labelers vote secret, not, or nothing on each: a pattern (which characters), a gazetteer of
secrets' names, a context rule (does an assignment or a quote lead up to it), the entropy of its characters, a gazetteer and shapes of
ordinary codes (articles, builds, dates, slugs, UUIDs), how often it changes between kinds of characters, and its frame: the two words before
it and the value itself with its digits taken out. A frame that MANY different values share over the whole corpus ("next token: word01234",
"next token: word56789") numbers things, so its values are no secrets, and the gazetteer has nothing to say on a name in it.

Expectation-maximisation over the counts of vote patterns (Dawid and Skene, 1979) estimates how often each labeler votes
what where the truth is secret or not. Votes alone don't say which of two classes is the secrets, nor do labelled codes
that aren't secrets agree less than secrets do; so ANCHORS, stated beliefs on each labeler, weigh in with the data, the gazetteers' as
a multiple of it: a fixed number of observations would let the classes turn over once a corpus is large enough. What a numbering frame holds
is one observation, however many values it has: they are one template's, and would otherwise be what all ordinary codes look like. The posteriors then train a logistic classifier on features of the span itself and its context, which decides alone.

Votes and features are one number below CODES, so the driver fits on how often each occurs in the whole corpus, at most
CODES rows; candidates themselves stay on the executors, frames as hashes of 64 bits. The text is scanned once.

Defined results: a null or empty text has no spans. Null and repeated doc_ids are rows like others. An empty
corpus, or one without candidates, accepts none. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import materialise

KINDS = ["email", "ip", "card", "phone", "secret"]
MIN_RUN, MIN_NAMED, CONTEXT = 8, 6, 24
#: Different values from which on a frame numbers things, and what a frame looks back on.
MANY, FRAME = 20, 48
#: Gazetteer of words that name a secret.
NAMES = ["password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential"]
#: Gazetteer of words that name a code which is no secret.
ORDINARY = ["sku", "isbn", "issn", "doi", "build", "version", "release", "commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "order", "invoice", "ticket", "serial", "model", "part", "item", "ref", "id", "date", "time", "page", "slug", "url", "file", "lot", "batch", "phone", "tel", "fax", "zip"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++")
_RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_NAMED = re.compile(rf"(?:{'|'.join(map(re.escape, NAMES))})[\x20\x22':=]{{0,6}}\Z", re.IGNORECASE)
_PLAIN = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(ORDINARY)})[\x20\x22':=#.]{{1,6}}\Z", re.IGNORECASE)
#: An assignment with a secret's name before it, and the run after it.
_ASSIGN = re.compile(r"[=:]")
_TITLE = re.compile(rf"(?:{'|'.join(map(re.escape, NAMES))})[\x22']?\x20{{0,3}}\Z", re.IGNORECASE)
_VALUE = re.compile(r"[=:>]?\x20{0,3}[\x22']?([A-Za-z0-9+/_.!@#$%^&*~?-]{6,})")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/_]?[01][0-9][-/_]?[0-3][0-9]")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_SLUG = re.compile(r"[A-Za-z]++(?:[-_/](?:[A-Za-z]++|[0-9]++))++\Z")
_UPPER_CODE = re.compile(r"[A-Z]{1,6}[-_/]?[0-9]{2,}(?:[-_/]?[A-Z0-9]{1,6})?\Z")

#: A value that numbers things: a word of three letters or more beside digits, at most two of each in turn.
_NUMBERED = re.compile(r"(?=.*[A-Za-z]{3})(?:[A-Za-z]++[+/_-]?0++|0++[+/_-]?[A-Za-z]++|[A-Za-z]++[+/_-]?0++[+/_-]?[A-Za-z]++|[A-Za-z]++[+/_-]?0++[+/_-]?[A-Za-z]++[+/_-]?0++)\Z")
_LETTERS = re.compile(r"[^\W\d_]++")

#: Emails, dotted numbers, digit groups and phones of one text: (start, end) each.
Spans = list[tuple[int, int]]


def emails(text: str) -> Spans:
    """From each @: the longest local part before it, not reaching into the match before, and the domain after it."""
    out: Spans = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> Spans:
    """Of each run of dotted numbers, four parts at a time."""
    out: Spans = []
    for m in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(v := p[0].lstrip("0")) <= 3 and int(v or 0) <= 255 for p in four):
                out.append((four[0].start(), four[3].end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Spans:
    out: Spans = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # nineteen digits and eighteen separators
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> Spans:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> list[Spans]:
    """Spans by kind: email, ip, card, phone."""
    if not _ANY.search(text):
        return [[], [], [], []]
    return [emails(text), ips(text), cards(text), phones(text)]


#: How many values each part of a code has, the last varying fastest.
PARTS = {"letters": 4, "digits": 4, "size": 6, "entropy": 4, "turns": 3, "shape": 6, "named": 3, "led": 4, "alike": 2}
CODES = math.prod(PARTS.values())
_SIZES, _ENTROPIES = (8, 12, 16, 24, 40), (2.5, 3.0, 3.5)


def kind_of(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def code_of(text: str, start: int, end: int) -> int:
    """What the labelers and the classifier see of a candidate, in one number.

    letters: none, lower, upper, both; digits: none, some, half or more, all; size and entropy by classes; turns between kinds of
    characters: two at most, some, one in four or more; shape: none, date or number, words joined, upper-case code, hex, UUID; named:
    no, as a secret, as an ordinary code; led: by nothing, an equals sign, a quote, a colon; alike: 0 here, ``marked`` tells it from the corpus.
    """
    run = text[start:end]
    n = end - start
    kinds = [kind_of(c) for c in run]
    digits, lower, upper = (kinds.count(k) for k in (0, 1, 2))
    entropy = -sum(m / n * math.log2(m / n) for m in Counter(run).values())
    turns = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    if _UUID.match(run):
        shape = 5
    elif not lower and not upper or _DATE.match(run):
        shape = 1
    elif _SLUG.match(run):
        shape = 2
    elif _HEX.match(run) and n >= 16:
        shape = 4
    else:
        shape = 3 if _UPPER_CODE.match(run) else 0
    before = text[max(0, start - CONTEXT) : start]
    last = before.rstrip(" ")[-1:]
    values = {
        "letters": (lower > 0) + 2 * (upper > 0),
        "digits": 0 if not digits else 3 if digits == n else 2 if 2 * digits >= n else 1,
        "size": sum(n >= x for x in _SIZES),
        "entropy": sum(entropy >= x for x in _ENTROPIES),
        "turns": 0 if turns <= 2 else 2 if 4 * turns >= n else 1,
        "shape": shape,
        "named": 1 if _NAMED.search(before) else 2 if _PLAIN.search(before) else 0,
        "led": 1 if last == "=" else 2 if last in ("\"", "'") and last else 3 if last == ":" else 0,
        "alike": 0,
    }
    code = 0
    for part, of in PARTS.items():
        code = code * of + values[part]
    return code


def parts_of(code: int) -> dict[str, int]:
    out = {}
    for part, of in reversed(PARTS.items()):
        code, out[part] = divmod(code, of)
    return out


def frame_of(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Hashes of a candidate's frame and of its value; none for a value without digits, or one that isn't a word or two and a number or two.

    The frame is the two words before the value, in small letters and without digits, and the value with each digit as 0.
    """
    run = text[start:end]
    made = _DIGIT.sub("0", run)
    if made == run and "0" not in run or not _NUMBERED.match(made):
        return None
    words = _LETTERS.findall(text, max(0, start - FRAME), start)[-2:]
    held = " ".join(words).lower() + "\n" + made
    return tuple(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in (held, run))


def named_values(text: str) -> Spans:
    """Runs that a secret's name and an assignment lead up to; what ends a sentence isn't part of them."""
    out: Spans = []
    free = 0
    for m in _ASSIGN.finditer(text):
        if m.start() >= free and _TITLE.search(text, max(0, m.start() - CONTEXT), m.start()) and (v := _VALUE.match(text, m.end())):
            run = v[1].rstrip(".!?")
            if len(run) >= MIN_NAMED:
                out.append((v.start(1), v.start(1) + len(run)))
            free = v.end()
    return out


def candidates(text: str, base: list[Spans]) -> list[tuple[int, int, int]]:
    """(start, end, code) of runs with a digit, of MIN_RUN characters or more, and of named values; none meets a base span or another."""
    taken = sorted(s for spans in base for s in spans)
    found = named_values(text) if "=" in text or ":" in text else []
    at, k = 0, 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in _RUN_CHARS:
            start -= 1
        at = end = _RUN.match(text, m.start()).end()
        while k < len(found) and found[k][1] <= start:
            k += 1
        if end - start >= MIN_RUN and not (k < len(found) and found[k][0] < end):
            found.insert(k, (start, end))
            k += 1
    out, k = [], 0
    for start, end in found:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if not any(s < end and e > start for s, e in taken[k : k + 8]):
            out.append((start, end, code_of(text, start, end)))
    return out


LABELERS = ["pattern", "gazetteer", "context", "entropy", "ordinary", "turns", "frame"]


def votes(code: int) -> tuple[int, ...]:
    """The LABELERS' votes on a candidate: 1 secret, 0 not, 2 no opinion."""
    p = parts_of(code)
    return (
        0 if not p["letters"] or p["shape"] == 1 else 1 if p["digits"] in (1, 2) and p["size"] >= 2 and p["shape"] in (0, 4) else 2,
        2 if p["alike"] else int(p["named"] == 1),
        int(p["led"] > 0),
        1 if p["entropy"] >= 2 else 0 if p["entropy"] == 0 else 2,
        0 if p["named"] == 2 or p["shape"] in (1, 2, 3, 5) else 2,
        1 if p["turns"] == 2 else 0 if p["turns"] == 0 else 2,
        0 if p["alike"] else 2,
    )


#: Belief on how often each labeler votes (not, secret, nothing) on what is no secret, on a secret, and its weight: as a multiple of the data.
ANCHORS = {
    "pattern": ((0.4, 0.2, 0.4), (0.1, 0.6, 0.3), 0.1),
    "gazetteer": ((0.998, 0.002, 0.0), (0.1, 0.9, 0.0), 9.0),
    "context": ((0.8, 0.2, 0.0), (0.1, 0.9, 0.0), 0.1),
    "entropy": ((0.3, 0.4, 0.3), (0.1, 0.6, 0.3), 0.1),
    "ordinary": ((0.5, 0.0, 0.5), (0.02, 0.0, 0.98), 9.0),
    "turns": ((0.4, 0.3, 0.3), (0.3, 0.4, 0.3), 0.1),
    "frame": ((0.3, 0.0, 0.7), (0.001, 0.0, 0.999), 9.0),
}
#: Belief on the share of secrets among candidates and its weight, as a multiple of the data; the classifier's ridge.
PRIOR, PRIOR_WEIGHT, RIDGE = 0.1, 0.2, 0.01


def posteriors(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns ``v`` (rows: patterns, columns: LABELERS) that occur ``n`` times: posteriors, prior, and rates[truth, labeler, vote]."""
    belief = np.array([[ANCHORS[x][y] for x in LABELERS] for y in (0, 1)])
    weight = np.array([ANCHORS[x][2] for x in LABELERS])[:, None]
    rates, prior = np.clip(belief, 0.001, 0.999), PRIOR
    said = v[:, :, None] == np.arange(3)
    for _ in range(rounds + 1):
        say = [np.where(said, np.log(rates[y]), 0).sum((1, 2)) for y in (0, 1)]
        p = 1 / (1 + np.exp(-np.clip(say[1] - say[0] + np.log(prior / (1 - prior)), -30, 30)))
        prior = float((n @ p / n.sum() + PRIOR_WEIGHT * PRIOR) / (1 + PRIOR_WEIGHT))
        for y, own in enumerate((1 - p, p)):
            held = (n * own) @ said.reshape(len(v), -1)
            held, total = held.reshape(-1, 3), (n * own).sum() + 1
            rates[y] = np.clip((held + weight * total * belief[y]) / (total - 1 + weight * total), 0.001, 0.999)
    return p, prior, rates


class Model:
    """Reliabilities by EM, and the classifier's weights; ``accepted`` codes are secrets."""

    def __init__(self, counts: dict[int, int], rounds: int = 50):
        self.accepted: frozenset[int] = frozenset()
        self.prior, self.rates = PRIOR, np.zeros((2, len(LABELERS), 3))
        codes = sorted(counts)
        if not codes:
            return
        n = np.array([counts[c] for c in codes], dtype=float)
        p, self.prior, self.rates = posteriors(np.array([votes(c) for c in codes]), n, rounds)
        x = np.array([self.features(c) for c in codes])
        self.weights = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton's steps with a ridge
            q = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            gradient = x.T @ (n * (p - q)) - RIDGE * self.weights
            hessian = (x * (n * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
            self.weights += np.linalg.solve(hessian, gradient)
        self.accepted = frozenset(c for c, f in zip(codes, x, strict=True) if f @ self.weights >= 0)

    @staticmethod
    def features(code: int) -> list[float]:
        """One column for each value of each part but the first; a secret's name with an assignment or a quote, and in a frame of alike values."""
        p = parts_of(code)
        return [1, *(p[part] == k for part, of in PARTS.items() for k in range(1, of)), p["named"] == 1 and p["led"] > 0, p["named"] == 1 and p["alike"] == 1]


SCANNED = "base array<struct<kind:int,start:int,end:int>>, more array<struct<start:int,end:int,code:int,frame:long,value:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """(row, base, more) and all columns of ``docs``: base spans and candidates of each row, which has a number as long as the table is stored."""
    own = docs.columns
    at = own.index("text")
    base_t = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    more_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("frame", pa.int64()), ("value", pa.int64())]))

    def rows(batches):
        for b in batches:
            base, more = [], []
            for t in b.column(at):
                text = t.as_py() or ""
                found = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, spans in enumerate(found) for s, e in spans])
                seen = []
                for s, e, c in candidates(text, found):
                    frame, value = frame_of(text, s, e) or (None, None)
                    seen.append({"start": s, "end": e, "code": c, "frame": frame, "value": value})
                more.append(seen)
            yield pa.RecordBatch.from_arrays([pa.array(base, base_t), pa.array(more, more_t), *b.columns], names=["base", "more", *own])

    schema = T.StructType([*T.StructType.fromDDL(SCANNED).fields, *docs.schema.fields])
    return docs.mapInArrow(rows, schema).withColumn("_row", F.monotonically_increasing_id())


def fit(scanned: DataFrame) -> tuple[Model, DataFrame]:
    """The model, fitted on how often each code occurs among all candidates, once for each frame that numbers things (at most CODES rows come to the driver), and (_row, alike): the places of candidates in frames that number things.

    Frames are counted by different values, each value once a task before it is sent, so a frame that holds a third of all candidates is no task's burden.
    """
    each = scanned.select("_row", F.posexplode("more").alias("pos", "m")).select("_row", "pos", "m.code", "m.frame", "m.value")
    pairs = each.where("frame IS NOT NULL").select("frame", "value").distinct()
    alike = materialise(pairs.groupBy("frame").count().where(F.col("count") >= MANY).select("frame"), "pii-frames")
    known = alike.withColumn("alike", F.lit(1))
    own = each.groupBy("code", "frame").agg(F.count("*").alias("n"))
    counts = own.join(known, "frame", "left").groupBy((F.col("code") + F.coalesce("alike", F.lit(0))).alias("code")).agg(F.sum(F.when(F.col("alike") == 1, 1).otherwise(F.col("n"))).alias("n")).collect()
    places = materialise(each.join(alike, "frame").groupBy("_row").agg(F.collect_list("pos").alias("alike")), "pii-alike")
    return Model({r["code"]: r["n"] for r in counts}), places


def marked(scanned: DataFrame, places: DataFrame) -> DataFrame:
    """``scanned`` with ``alike``; few places are broadcast by their files' size, more are joined."""
    return scanned.join(places, "_row", "left")


def secrets_of(more: list[dict], alike: list[int] | None, accepted: frozenset[int]) -> list[tuple[int, int]]:
    """Spans of the candidates whose code, with what the corpus says of their frame, is a secret's."""
    held = frozenset(alike or ())
    return [(m["start"], m["end"]) for i, m in enumerate(more) if m["code"] + (i in held) in accepted]


def told(base: list[dict], secrets: list[tuple[int, int]]) -> tuple[list[int], str, str]:
    """Counts of the base kinds, the base's digest, and all spans."""
    own = [f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in base]
    n = [sum(s["kind"] == k for s in base) for k in range(4)]
    return n, hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + [f"secret:{s}:{e}" for s, e in secrets])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row (doc_id, text)."""
    scanned = materialise(scan(docs.select("doc_id", "text")).drop("text"), "pii-scan")
    model, places = fit(scanned)
    accepted = model.accepted
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            out = [told(x, secrets_of(y, z, accepted)) for x, y, z in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            n = [pa.array([o[0][k] for o in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return marked(scanned, places).select("doc_id", "base", "more", "alike").mapInArrow(rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, base: list[dict], secrets: list[tuple[int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap the outer or first one counts."""
    found = [(s["start"], -s["end"], s["kind"]) for s in base] + [(s, -e, 4) for s, e in secrets]
    out, at = [], 0
    for start, end, k in sorted(found):
        if start >= at:
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
            at = -end
        elif -end > at:  # overlaps the span before and goes on after it
            at = -end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by ``[EMAIL]`` and the like; all other columns stay."""
    own = docs.columns
    at = own.index("text")
    names = [f"_{i}" if i != at else "text" for i in range(len(own))]  # what the columns are called doesn't matter, nor whether a name comes twice
    scanned = materialise(scan(docs.toDF(*names)), "pii-scan")
    model, places = fit(scanned)
    accepted = model.accepted

    def rows(batches):
        for b in batches:
            out = []
            for t, base, more, alike in zip(*(b.column(k).to_pylist() for k in (at, -3, -2, -1)), strict=True):
                out.append(None if t is None else masked(t, base, secrets_of(more, alike, accepted)))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : -3]], names=names)

    return marked(scanned, places).select(*names, "base", "more", "alike").mapInArrow(rows, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])).toDF(*own)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
