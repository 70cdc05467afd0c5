"""Personal data in documents: exact patterns, and weak supervision for what they miss.

The base spans are those of four patterns with their checks. Beyond them, looser patterns propose candidates. Labelers vote on each:
a strict shape, a gazetteer, the words before it, and its borders. The votes of all candidates are counted by their pattern, expectation
maximisation over these counts estimates how reliable each labeler is for each kind, and the posteriors are the soft labels on which a logistic
classifier over the candidates' features is trained. Candidates that it accepts become spans unless they touch a base span.

Texts are read once: the table written for training holds spans and candidates, not texts, and the classifier's verdicts are applied
to it. What the driver gets is a count per pattern of votes and features, of which there are at most 81 * 432.

Edge cases: a NULL or empty text has no spans; no candidates mean an empty model that accepts nothing; repeated rows each get a
row; an empty table gives an empty result; only the key and text columns are read. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from samewise.sources.shared import written

KINDS = ("email", "ip", "card", "phone")
SPAN = "start:int,end:int,kind:string"
MARKS = f"struct<base:array<struct<{SPAN}>>,more:array<struct<{SPAN},votes:string,features:string>>>"
_SPAN = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]
_MARKS = pa.struct([("base", pa.list_(pa.struct(_SPAN))), ("more", pa.list_(pa.struct([*_SPAN, ("votes", pa.string()), ("features", pa.string())])))])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
# Words that speak for each kind, words that speak against any, ends of mail domains, telephone areas,
# prefixes of addresses in use, first digits of card issuers.
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "dial"),
}
AGAINST = ("isbn", "version", "order", "invoice", "figure", "page", "serial", "total", "part")
MAIL_ENDS = ("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "eu")
AREAS = ("800", "833", "844", "855", "866", "877", "888", "202", "206", "212", "213", "214", "215", "281", "303", "305", "310", "312", "404", "408", "415", "416", "469", "503", "512", "514", "602", "604", "613", "617", "646", "647", "650", "702", "713", "718", "720", "773", "786", "818", "832", "858", "903", "916", "917", "949", "972")
PREFIXES = ("2001", "2003", "2400", "2404", "2406", "2600", "2601", "2606", "2607", "2620", "2800", "2804", "2a00", "2a01", "2a02", "2a03", "2c0f", "fc", "fd", "fe80")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost matches, found from each @: the characters before it back to the match before, the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, "email"
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the four patterns, by start and then kind."""
    if not _HINT.search(text):
        return []
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that touch no base span."""
    kinds = []
    if "dot" in text:
        kinds.append("email")
    if ":" in text:
        kinds.append("ip")
    if _HINT.search(text):
        kinds += ["card", "phone"]
    found = [(m.start(), m.end(), kind) for kind in kinds for m in _LOOSE[kind].finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    out, i, done = [], 0, 0
    for start, end, kind in found:
        while i < len(base) and base[i][0] < start:
            done = max(done, base[i][1])
            i += 1
        if start >= done and not (i < len(base) and base[i][0] < end):
            out.append((start, end, kind))
            done = end
    return out


def votes(text: str, start: int, end: int, kind: str) -> str:
    """One character per labeler: 1 for, 0 against, - for no opinion."""
    found = text[start:end]
    digits = _digits(found)
    if kind == "email":
        shape, last = not found.startswith((".", "-")), _WORD.findall(found)[-1].lower()
        listed = last in MAIL_ENDS
    elif kind == "ip":
        shape, listed = found.count(":") == 7, found.lower().startswith(PREFIXES)
    elif kind == "card":
        shape, listed = luhn(digits), digits.startswith(ISSUERS)
    else:
        shape, listed = digits[0] not in "01" and digits[3] not in "01", digits.startswith(AREAS) or digits[3:6] == "555"
    before = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])}
    context = "1" if before & set(CUES[kind]) else "0" if before & set(AGAINST) else "-"
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    border = "0" if any(c.isalnum() or c in "#/=_" for c in near) else "1" if near.strip() == near == "" else "-"
    return f"{int(shape)}{'1' if listed else '-'}{context}{border}"


def features(text: str, start: int, end: int, kind: str, vote: str) -> str:
    """kind, digits in thirds, first separator, and the votes of context and borders: 4 * 3 * 4 * 9 values at most."""
    found = text[start:end]
    share = min(2, 3 * len(_digits(found)) // len(found))
    separator = next((str(i) for i, c in enumerate("-. ") if c in found), "3")
    return f"{kind}|{share}|{separator}|{vote[2]}|{vote[3]}"


def marked(text: Column) -> Column:
    """A struct of the base spans and of the candidates with their votes and features."""

    @arrow_udf(MARKS)
    def column(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            t = x.as_py() or ""
            base = base_spans(t)
            more = [(*s, v, features(t, *s, v)) for s in loose_spans(t, base) for v in (votes(t, *s),)]
            rows.append({"base": [dict(zip(("start", "end", "kind"), s, strict=True)) for s in base], "more": [dict(zip(("start", "end", "kind", "votes", "features"), s, strict=True)) for s in more]})
        return pa.array(rows, _MARKS)

    return column(text)


def posteriors(counted: Iterable[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """How likely each (kind, votes) is personal data, by expectation maximisation over the counts of the patterns of each kind."""
    by_kind: dict[str, list[tuple[str, int]]] = {}
    for kind, vote, count in sorted(counted):
        by_kind.setdefault(kind, []).append((vote, count))
    return {(kind, vote): p for kind, rows in by_kind.items() for (vote, _), p in zip(rows, _maximised(rows, rounds), strict=True)}


def _maximised(rows: list[tuple[str, int]], rounds: int) -> list[float]:
    """One kind's posteriors, by pattern of votes: each labeler says yes to personal data at one rate and to other candidates at another."""
    n = np.array([c for _, c in rows], float)
    vote = np.array([[{"1": 1, "0": 0}.get(c, -1) for c in v] for v, _ in rows])
    said, yes = vote >= 0, vote == 1
    post = (1 + yes.sum(axis=1)) / (2 + said.sum(axis=1))
    for _ in range(rounds):
        rate = []
        for p, guess in ((post, 0.8), (1 - post, 0.2)):  # a guess worth four votes keeps rare labelers sane
            weight = (n * p)[:, None]
            rate.append(((weight * yes).sum(axis=0) + 4 * guess) / ((weight * said).sum(axis=0) + 4))
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + np.where(said, np.where(yes, np.log(rate[0] / rate[1]), np.log((1 - rate[0]) / (1 - rate[1]))), 0).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post.tolist()


def classifier(counted: Iterable[tuple[str, str, str, int]], rounds: int = 25) -> dict[str, float]:
    """The probability of each feature pattern, by logistic regression on the posteriors of (kind, votes, features, count) rows."""
    rows = sorted(counted)
    if not rows:
        return {}
    sums: dict[tuple[str, str], int] = {}
    for k, v, _, c in rows:
        sums[k, v] = sums.get((k, v), 0) + c
    soft = posteriors([(k, v, c) for (k, v), c in sums.items()])
    patterns = sorted({f for _, _, f, _ in rows})
    names = sorted({(i, x) for f in patterns for i, x in enumerate(f.split("|"))})
    grid = np.array([[1.0, *(f.split("|")[i] == x for i, x in names)] for f in patterns])
    weight, target = np.zeros(len(patterns)), np.zeros(len(patterns))
    for k, v, f, c in rows:
        weight[patterns.index(f)] += c
        target[patterns.index(f)] += c * soft[k, v]
    beta = np.zeros(grid.shape[1])
    for _ in range(rounds):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(grid @ beta, -30, 30)))
        slope = grid.T @ (target - weight * p) - 0.1 * beta
        beta += np.linalg.solve(grid.T @ (grid * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(len(beta)), slope)
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(grid @ beta, -30, 30)))).tolist(), strict=True))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of docs: key, base and spans, both arrays of (start, end, kind) by start and then kind."""
    rows = written(docs.select(F.col(key), marked(F.col(text)).alias("m")), "personal").select(key, "m.base", "m.more")
    counts = rows.select(F.explode("more").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    accepted = sorted(f for f, p in classifier([tuple(r) for r in counts.collect()]).items() if p >= least)
    added = F.filter("more", lambda c: c["features"].isin(accepted) if accepted else F.lit(False))
    rank = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"])
    both = F.concat("base", F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return rows.select(F.col(key), "base", F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def _written_out(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written_out("base").cast("binary"), 256).alias("base_sha256"), _written_out("spans").alias("spans"))
