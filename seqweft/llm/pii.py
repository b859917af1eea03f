"""Personal data: fixed patterns for e-mail, ip, card and phone, and bootstrapped contextual extraction of further identifiers.

Seed instances are what the fixed patterns find and, as one kind more, secrets: key-like strings behind a word such as
token or password, or with a provider's prefix. The words around an occurrence make lexical patterns. Spark scores the
graph of patterns and instances in rounds until nothing changes: a pattern is worth the share of confident instances of
a kind among the different ones in it (smoothed; unknown ones count in part), an instance the noisy-or of its patterns.
Identifier-like strings outside the seeds (numbers with separators, addresses in any spelling, keys and codes, also as
parts of long strings) that end up confident are found wherever they stand. Contexts that all kinds share, or few
instances, discover nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, string_array

#: Kinds of the fixed patterns, and all kinds, in the order of listings.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Rounds of scoring at most (they end when nothing changes); least score of a pattern and confidence of an instance.
ROUNDS, PATTERN_AT, INSTANCE_AT = 12, 0.8, 0.9
#: What a pattern's denominator is raised by, and how much of an instance counts there whose kind is unknown.
DOUBT, UNKNOWN = 2.0, 0.2
#: Digits of a number or code that could tell one thing from others, in all its parts together.
DIGITS = 4
#: Longer values and words of patterns are named by their digest.
LONG = 200

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\S+")
_TRIM = "\"'.,;:!?()[]{}<>*&%$#|="
#: Words before a secret and prefixes that providers give their keys (fixed values).
_SECRET_WORD = re.compile(r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|bearer|(?:api|access|private|auth)[ _-]?key)(?![a-z])[\"']?[ \t]*[:=]?[ \t]*[\"']?([A-Za-z0-9+/_-]{12,}={0,2})")
_PROVIDER = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ()./-]{0,3}[0-9])+(?![0-9A-Za-z])")
_CODE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+.-]*={0,2}")
_ADDRESS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-äöüßéèàñç")
_SPELLED = re.compile(r"(?i)[ ]?[(\[{<][ ]?at[ ]?[)\]}>][ ]?")
_SPELLED_END = re.compile(r"(?i)[a-z0-9-]++(?:(?:\.|[ ]?[(\[{<][ ]?dot[ ]?[)\]}>][ ]?)[a-z0-9-]++)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each of KINDS; leftmost matches without overlap, failing ones dropped without retry."""
    emails, at, done = [], text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            emails.append((left, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return [emails, [], [], []]
    least = lambda p: len(p) <= 3 and int(p or "0") <= 255
    ips = [m.span() for m in _IP.finditer(text) if all(least(p.lstrip("0")) for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Keys with a digit behind a secret's word, and keys with a provider's prefix; leftmost, without overlap."""
    if not _DIGIT.search(text):
        return []
    found = [m.span(1) for m in _SECRET_WORD.finditer(text) if _DIGIT.search(m.group(1))] + [m.span() for m in _PROVIDER.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def listing(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans, strict=False) for a, b in sorted(s))


def _name(s: str) -> str:
    return s if len(s) <= LONG else hashlib.sha256(s.encode()).hexdigest()


class Contexts:
    """Lexical patterns of places in a text: the two words before, and the words on both sides. What stands before or behind
    the place in its own white-space token is a word too."""

    def __init__(self, text: str):
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.ends = [b for _, b in self.words]

    def _word(self, a: int, b: int) -> str:
        raw = self.text[a:b]
        return _name((raw.strip(_TRIM) or raw).lower())

    def of(self, a: int, b: int) -> list[str]:
        i = bisect.bisect_right(self.ends, a)  # the word that holds a
        k = bisect.bisect_left(self.ends, b)  # the one that holds the last letter
        before = [self._word(*self.words[j]) for j in range(max(0, i - 2), i)]
        start = self.words[i][0]
        if self.text[start:a].strip(_TRIM):
            before.append(self._word(start, a))
        end = self.words[k][1]
        after = self._word(b, end) if self.text[b:end].strip(_TRIM) else self._word(*self.words[k + 1]) if k + 1 < len(self.words) else None
        out = []
        if len(before) >= 2:
            out.append(f"2 {before[-2]} {before[-1]}")
        if before and after is not None:
            out.append(f"1 {before[-1]} _ {after}")
        return out


def _digits(s: str) -> int:
    return sum("0" <= c <= "9" for c in s)


def candidates(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Identifier-like strings outside the spans: addresses without a full domain or spelled out, numbers with separators, keys and codes."""
    found: list[tuple[int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > done and text[a - 1] in _ADDRESS:
            a -= 1
        while b < len(text) and text[b] in _ADDRESS:
            b += 1
        if a < at and b > at + 1:
            found.append((a, b))
        done = b
        at = text.find("@", b)
    for m in _SPELLED.finditer(text):
        a, end = m.start(), _SPELLED_END.match(text, m.end())
        while a and text[a - 1] in _ADDRESS:
            a -= 1
        if a < m.start() and end:
            found.append((a, end.end()))
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMBER.finditer(text) if _digits(m.group()) >= DIGITS]
        for m in _CODE.finditer(text):
            s = m.group().rstrip(".+-_")
            if _digits(s) >= DIGITS and not s.isdigit():
                found.append((m.start(), m.start() + len(s)))
    taken = sorted(x for s in spans for x in s)
    out: list[tuple[int, int]] = []
    k = upto = 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= upto and not (k < len(taken) and taken[k][0] < b):
            out.append((a, b))
            upto = b
    return out


_OCCURRENCE = "array<struct<kind:string,value:string,start:long,stop:long,patterns:array<string>>>"
_ADDED = "array<struct<kind:string,start:long,stop:long>>"


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("patterns", pa.list_(pa.string()))]))
    for b in batches:
        texts = string_array(b.column("text")).to_pylist()
        base, found = [], []
        for t in texts:
            spans = base_spans(t)
            base.append(spans)
            seeds = [*spans, secret_spans(t)]
            rows = [(k, a, z) for k, s in zip(KINDS, seeds, strict=True) for a, z in s] + [(None, a, z) for a, z in candidates(t, seeds)]
            near = Contexts(t) if rows else None
            found.append([{"kind": k, "value": _name(t[a:z].lower()), "start": a, "stop": z, "patterns": near.of(a, z)} for k, a, z in rows])
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("doc_id"), *(pa.array([len(s[i]) for s in base], pa.int64()) for i in range(len(BASE))), pa.array([listing(s) for s in base]), pa.array(found, kind)],
            ["key", "doc_id", *(f"n_{k}" for k in BASE), "base", "found"],
        )


def discovered(scanned: DataFrame) -> DataFrame | None:
    """(value, kind) of identifiers that the patterns discover; None if there are none. scanned: a written table with the column found."""
    seen = scanned.select(F.explode("found").alias("x")).select("x.value", "x.kind", F.explode("x.patterns").alias("pattern"))
    edges = stash(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    size = edges.groupBy("pattern").agg((F.count("kind") + UNKNOWN * F.count_if(F.col("kind").isNull()) + DOUBT).alias("n")).where(f"n > {1 + DOUBT}")
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("conf", F.lit(1.0))
    known, fresh, before = seeds, None, None
    for _ in range(ROUNDS):
        good = edges.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.sum("conf").alias("sum"))
        score = F.least(F.col("sum") / F.col("n"), F.lit(0.99))
        patterns = stash(good.join(size, "pattern").select("pattern", "kind", score.alias("score")).where(score >= PATTERN_AT), "patterns")
        each = edges.where("kind is null").select("pattern", "value").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("conf"))
        best = each.groupBy("value").agg(F.max(F.struct("conf", "kind")).alias("b")).select("value", "b.kind", "b.conf").where(F.col("conf") >= INSTANCE_AT)
        last, fresh = fresh, stash(best, "instances")
        discard(patterns, *([last] if last is not None else []))
        state = fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        known = seeds.unionByName(fresh)
    discard(edges)
    return fresh if state[0] else None


def _scanned(src: DataFrame) -> DataFrame:
    kind = dict(src.dtypes)["doc_id"]
    schema = f"key long, doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + f", base string, found {_OCCURRENCE}"
    return stash(src.select("key", "doc_id", "text").mapInArrow(_scan, schema), "scanned")


def _added(scanned: DataFrame) -> DataFrame | None:
    """(key, added): of each row the list of discovered spans."""
    more = discovered(scanned)
    if more is None:
        return None
    rows = scanned.select("key", F.explode(F.filter("found", lambda x: x["kind"].isNull())).alias("x")).select("key", "x.value", "x.start", "x.stop")
    return rows.join(more.select("value", "kind"), "value").groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the fixed patterns) and spans (of all kinds) of every row.

    Null texts count as empty. Ids are only passed on, so repeated rows repeat and null ids stay; a value that stands in
    many rows counts once for each pattern. Other columns are ignored; an empty table gives no rows.
    """
    src = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = _scanned(src)
    added = _added(scanned)
    base = F.sha2("base", 256).alias("base_sha256")
    counts = ["doc_id", *(f"n_{k}" for k in BASE)]
    place = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    own = F.transform(F.filter("found", lambda x: x["kind"].isNotNull()), lambda x: F.struct(place(x["kind"]).alias("o"), x["start"].alias("a"), x["stop"].alias("b"), x["kind"].alias("k")))
    scanned = scanned.withColumn("added", F.lit(None).cast(_ADDED)) if added is None else scanned.join(added, "key", "left")
    new = F.transform(F.coalesce("added", F.array().cast(_ADDED)), lambda x: F.struct(place(x["kind"]).alias("o"), x["start"].alias("a"), x["stop"].alias("b"), x["kind"].alias("k")))
    text = F.array_join(F.transform(F.sort_array(F.concat(own, new)), lambda x: F.concat_ws(":", x["k"], x["a"], x["b"])), ",")
    return scanned.select(*counts, base, text.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets.

    Of spans that overlap, the one that begins first (of those the one that ends first, then by kind) gives its name,
    and the others' letters go too. Null texts stay null, other columns stay as they are, repeated rows repeat.
    """
    key = "pii_key_"
    while key in docs.columns:
        key += "_"
    rows = stash(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    added = _added(_scanned(rows.select(F.col(key).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    extra = key + "added"
    if added is None:
        rows = rows.withColumn(extra, F.array().cast(_ADDED))
    else:
        rows = rows.join(added.select(F.col("key").alias(key), F.col("added").alias(extra)), key, "left")
    names = docs.columns

    def work(batches):
        for b in batches:
            texts = []
            for t, more in zip(b.column(text_col).to_pylist(), b.column(extra).to_pylist(), strict=True):
                if t is not None:
                    spans = [(a, z, k) for k, s in zip(KINDS, [*base_spans(t), secret_spans(t)], strict=True) for a, z in s] + [(x["start"], x["stop"], x["kind"]) for x in more or ()]
                    out, at = [], 0
                    for a, z, k in sorted(spans):
                        if z <= at:
                            continue
                        out += [t[at : max(a, at)], f"<{k.upper()}>" if a >= at else ""]
                        at = z
                    t = "".join([*out, t[at:]])
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if n == text_col else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.select(*names, extra).mapInArrow(work, docs.schema)
