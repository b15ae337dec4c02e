"""Personal data in texts: fixed patterns, and spans that a semi-Markov conditional random field adds."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, texts

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at a run of digits or nowhere in it; possessive runs keep long numbers linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Training: documents whose base spans serve as labels, at most (by seeded order), and spans of each.
TRAIN_DOCS = 120
TRAIN_SPANS = 2
#: Digit groups that an entity may span.
MOST_GROUPS = 8
#: Added spans need this margin in log-odds.
MARGIN = 2.0

#: Numbers: digit groups with at most three separators between them.
_RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20()./:+-]{0,3}[0-9])*+")
_GROUP = re.compile(r"[0-9]+")
_SPELT = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\x20?[(\[{](?:at|@)[)\]}]\x20?|\x20at\x20|\x20?@\x20?)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[{](?:dot|\.)[)\]}]\x20?|\x20dot\x20|\x20\.\x20)[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_CUES = {
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|carte|karte|tarjeta)\W{0,3}(?:no|number|nr)?\W{0,3}$", re.IGNORECASE),
    "phone": re.compile(r"(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)\W{0,3}(?:no|number|nr)?\W{0,3}$", re.IGNORECASE),
    "ip": re.compile(r"(?:\bip|host|server|address)\W{0,3}$", re.IGNORECASE),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: its local part must end at an @, so each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = "".join(_GROUP.findall(m.group()))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _GROUP.findall(m.group()))) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FEATURES = [
    "bias", "few_digits", "digits_10", "digits_11", "digits_12_13", "digits_14_15", "digits_16", "digits_17_19", "many_digits",
    "one_group", "two_groups", "three_groups", "four_groups", "more_groups", "checksum", "octets", "tail_3_4", "fours",
    "plus", "brackets", "dots", "hyphens", "spaces", "mixed", "glued", "part_of_run", "cue", "bracketed_at", "bare_at", "known_ending",
]
_NUMBER = {n: i for i, n in enumerate(FEATURES)}
#: The weights before training, by kind; training starts here and is drawn back here.
_PRIOR = {
    "email": {"bias": -1, "bracketed_at": 4, "bare_at": -0.5, "known_ending": 4, "cue": 1},
    "ip": {"bias": -4, "octets": 5, "dots": 1, "mixed": -3, "glued": -4, "part_of_run": -3, "cue": 2},
    "card": {"bias": -5, "checksum": 3, "digits_16": 3, "digits_14_15": 2, "digits_17_19": 1, "few_digits": -6, "digits_10": -6, "digits_11": -6,
             "digits_12_13": -4, "many_digits": -6, "fours": 2, "glued": -4, "part_of_run": -3, "cue": 3, "mixed": -2, "plus": -4},
    "phone": {"bias": -5, "tail_3_4": 3, "digits_10": 3, "digits_11": 2, "digits_12_13": 0, "plus": 3, "brackets": 2, "few_digits": -2,
              "one_group": -3, "octets": -6, "digits_16": -5, "many_digits": -6, "digits_14_15": -3, "digits_17_19": -5,
              "glued": -4, "part_of_run": -3, "cue": 3, "fours": -4},
}


def prior() -> np.ndarray:
    out = np.zeros((len(KINDS), len(FEATURES)))
    for k, kind in enumerate(KINDS):
        for name, weight in _PRIOR[kind].items():
            out[k, _NUMBER[name]] = weight
    return out


def _number_features(text: str, groups: Sequence[tuple[int, int]], leads: bool, run_start: int) -> Iterator[tuple[int, int, list, dict]]:
    """Spans of one to MOST_GROUPS digit groups from the first on: start, end, whole-span features, and features by kind.

    ``groups`` holds one group more where the run goes on; ``leads``: the first one begins the run.
    """
    start = groups[0][0]
    while start > run_start and text[start - 1] in "(+":
        start -= 1
    before, left = text[max(0, start - 24) : start], text[start - 1 : start]
    by_kind = {k: ["cue"] for k, cue in _CUES.items() if cue.search(before)}
    plus, glued_left = "+" in text[start : groups[0][0]], bool(left) and (left.isalnum() or left in '"=_#/')
    parts, between, size = [], set(), 0
    for n, (at, end) in enumerate(groups, 1):
        size += end - at
        if n > MOST_GROUPS or size >= 20:
            return
        if parts:
            between.update(text[groups[n - 2][1] : at])
        parts.append(text[at:end])
        digits = "".join(parts)
        has = ["bias"]
        has.append(
            "few_digits" if size < 10 else "digits_10" if size == 10 else "digits_11" if size == 11 else "digits_12_13" if size < 14
            else "digits_14_15" if size < 16 else "digits_16" if size == 16 else "digits_17_19"
        )
        has.append(("one_group", "two_groups", "three_groups", "four_groups")[n - 1] if n <= 4 else "more_groups")
        if 12 <= size <= 19 and luhn(digits):
            has.append("checksum")
        if n == 4 and all(map(_octet, parts)):
            has.append("octets")
        if n >= 3 and [len(p) for p in parts[-2:]] == [3, 4] and len(parts[-3]) == 3:
            has.append("tail_3_4")
        if n >= 3 and all(len(p) == 4 for p in parts[:-1]):
            has.append("fours")
        if plus:
            has.append("plus")
        if "(" in text[start:end]:
            has.append("brackets")
        if between:
            has.append({".": "dots", "-": "hyphens", " ": "spaces"}.get(next(iter(between)), "mixed") if len(between) == 1 else "mixed")
        right = text[end : end + 1]
        if glued_left or right and (right.isalnum() or right in '"_%'):
            has.append("glued")
        if not leads or n < len(groups):
            has.append("part_of_run")
        yield start, end, has, by_kind


def _number_spans(text: str, run: tuple[int, int]) -> Iterator[tuple[int, int, list, dict]]:
    """Candidate spans of a run of numbers, by start; a few groups of the run are held at a time."""
    ahead = ((g.start(), g.end()) for g in _GROUP.finditer(text, *run))
    groups = deque(islice(ahead, MOST_GROUPS + 1))
    leads = True
    while groups:
        yield from _number_features(text, groups, leads, run[0])
        groups.popleft()
        groups.extend(islice(ahead, 1))
        leads = False


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of numbers with at least seven digits."""
    for m in _RUN.finditer(text):
        digits = 0
        for g in _GROUP.finditer(text, *m.span()):
            digits += g.end() - g.start()
            if digits >= 7:
                yield m.span()
                break


def _spelt(text: str) -> Iterator[tuple[int, int, list]]:
    """Spelt-out addresses: start, end, features."""
    lower = text.lower() if "@" in text or "(at" in text or "[at" in text or " dot " in text or "(dot" in text or "[dot" in text else ""
    if lower and ("dot" in lower or "at" in lower or "@" in lower):
        for m in _SPELT.finditer(text):
            found = m.group().lower()
            bare = " at " in found
            if bare and "dot" not in found:
                continue  # "look at this.txt" is no address
            has = ["bias", "bare_at" if bare else "bracketed_at"]
            if re.search(r"(?:\.|dot[)\]}]?)\s?(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", found):
                has.append("known_ending")
            yield m.start(), m.end(), has


def _vector(has: Iterable[str]) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    for name in has:
        out[_NUMBER[name]] = 1.0
    return out


def candidates(text: str) -> list[list[tuple[int, int, int, np.ndarray]]]:
    """Regions of candidate segments (start, end, kind, features); regions do not overlap. For training windows."""
    regions = [[(start, end, 0, _vector(has))] for start, end, has in _spelt(text)]
    for run in _runs(text):
        spans = _number_spans(text, run)
        regions.append([(a, b, k, _vector([*has, *extra.get(kind, ())])) for a, b, has, extra in spans for k, kind in enumerate(KINDS[1:], 1)])
    return [region for region in regions if region]


def _by_end(region: list) -> tuple[list[int], dict[int, list[int]], dict[int, int]]:
    """Cut points of a region, its candidates by end, and the number of each cut point."""
    cuts = sorted({c for x in region for c in x[:2]})
    place = {c: i for i, c in enumerate(cuts)}
    ends: dict[int, list[int]] = {}
    for n, x in enumerate(region):
        ends.setdefault(place[x[1]], []).append(n)
    return cuts, ends, place


def best(region: list, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Highest-scoring set of segments that do not overlap: boundaries and kinds jointly, over bounded segments."""
    return _chosen([(a, b, k, float(weights[k] @ x) - MARGIN) for a, b, k, x in region])


def _chosen(segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The same for segments (start, end, kind, score above the margin)."""
    cuts, ends, place = _by_end(segments)
    score, via = [0.0] * len(cuts), [-1] * len(cuts)
    for c in range(1, len(cuts)):
        score[c] = score[c - 1]
        for n in ends.get(c, ()):
            s = score[place[segments[n][0]]] + segments[n][3]
            if s > score[c]:
                score[c], via[c] = s, n
    out, c = [], len(cuts) - 1
    while c > 0:
        if via[c] < 0:
            c -= 1
        else:
            start, end, kind, _ = segments[via[c]]
            out.append((start, kind, end))
            c = place[start]
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _gradient(region: list, gold: set, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold segments of a region over all segmentations, and its gradient."""
    cuts, ends, place = _by_end(region)
    kinds, features = np.array([x[2] for x in region]), np.stack([x[3] for x in region])
    scores = (weights[kinds] * features).sum(1)
    first, last, score = [place[x[0]] for x in region], [place[x[1]] for x in region], scores.tolist()
    n = len(cuts)
    ahead, behind = [0.0] * n, [0.0] * n
    for c in range(1, n):
        ahead[c] = _log_sum([ahead[c - 1], *(ahead[first[i]] + score[i] for i in ends.get(c, ()))])
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(first):
        starts.setdefault(c, []).append(i)
    for c in range(n - 2, -1, -1):
        behind[c] = _log_sum([behind[c + 1], *(behind[last[i]] + score[i] for i in starts.get(c, ()))])
    p = np.exp(np.array(ahead)[first] + scores + np.array(behind)[last] - ahead[-1])
    is_gold = np.array([(a, k, b) in gold for a, b, k, _ in region], float)
    gradient = np.zeros_like(weights)
    np.add.at(gradient, kinds, (is_gold - p)[:, None] * features)
    return float(scores @ is_gold) - ahead[-1], gradient


def _variants(text: str, span: tuple[int, int, int]) -> Iterator[tuple[str, tuple[int, int, int]]]:
    """A labelled window as it is, and rewritten in forms that the fixed patterns miss."""
    start, kind, end = span
    found = text[start:end]
    forms = [found]
    if kind == 2:
        digits = "".join(_GROUP.findall(found))
        forms += [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in (".", "  ")]
    elif kind == 3:
        digits = "".join(_GROUP.findall(found))[-10:]
        forms += [f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}"]
    elif kind == 0:
        name, _, host = found.partition("@")
        forms += [f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}"]
    for form in forms:
        yield text[:start] + form + text[end:], (start, kind, start + len(form))


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 30, pull: float = 0.5) -> np.ndarray:
    """Weights by kind, drawn to the prior by `pull`, from windows of text with their base spans."""
    start = prior()
    weights, seen = start.copy(), []
    for text, spans in windows:
        for span in spans[:1]:
            for variant, gold in _variants(text, span):
                marked = {gold, *(s for s in spans if s[0] >= span[2] and variant == text), *(s for s in spans if s[2] <= span[0])}
                seen += [(region, marked) for region in candidates(variant)]
    moved = np.full_like(weights, 1e-6)
    for _ in range(rounds if seen else 0):
        gradient = -pull * (weights - start)
        for region, marked in seen:
            gradient += _gradient(region, marked, weights)[1] / max(1.0, len(seen) / 100)
        moved += gradient * gradient
        weights += 0.5 * gradient / np.sqrt(moved)
    return weights


def _scored(text: str, weights: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """Segments whose score is above the margin, runs one after the other and by start in each."""
    by_name = [dict(zip(FEATURES, w, strict=True)) for w in weights.tolist()]
    for start, end, has in _spelt(text):
        yield start, end, 0, sum(map(by_name[0].__getitem__, has)) - MARGIN
    for run in _runs(text):
        for start, end, has, extra in _number_spans(text, run):
            for k, kind in enumerate(KINDS[1:], 1):
                of = by_name[k].__getitem__
                score = sum(map(of, has)) + sum(map(of, extra.get(kind, ()))) - MARGIN
                if score > 0:
                    yield start, end, k, score


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span.

    A segment at or below the margin is in no best segmentation, so only the
    others are kept, and the dynamic programme runs on each cluster of them
    that overlap: between clusters it would start from the same score again.
    """
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, cluster, end = [], [], 0

    def close() -> None:
        for start, kind, stop in _chosen(cluster):
            i = bisect.bisect_left(covered, stop, key=lambda c: c[0])
            if i == 0 or covered[i - 1][1] <= start:
                out.append((start, kind, stop))

    for segment in _scored(text, weights):
        if segment[3] <= 0:
            continue
        # Spelt-out addresses (kind 0) come first and are no rivals of numbers, which begin anew behind them.
        if cluster and (not cluster[0][2] or segment[0] >= end):
            close()
            cluster, end = [], 0
        cluster.append(segment)
        end = max(end, segment[1])
    if cluster:
        close()
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("window", pa.string()), ("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        rows = []
        for doc, data in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            text = data.decode("utf-8", "replace")
            for a, k, b in base_spans(text)[:TRAIN_SPANS]:
                if b - a <= 80:
                    at = max(0, a - 40)
                    rows.append((doc, text[at : b + 40], a - at, k, b - at))
        if rows:
            yield batch_of(schema, zip(*rows, strict=True))


def trained(docs: DataFrame) -> np.ndarray:
    """Weights from a bounded sample: TRAIN_DOCS documents with digits or an @, TRAIN_SPANS windows of each."""
    bounded_batches(docs.sparkSession)
    ids = docs.filter(F.col("text").rlike("@|[0-9]{4}")).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    some = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    rows = some.mapInArrow(_windows, "doc_id long, window string, start long, kind long, end long").collect()
    windows = sorted((r.window, [(r.start, r.kind, r.end)]) for r in rows)
    return train([(w, sorted({*s, *base_spans(w)}, key=lambda x: (x not in s, x))) for w, s in windows])


def _find(weights: np.ndarray):
    schema = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in texts(batch):
                text = data.decode("utf-8", "replace")
                base = base_spans(text)
                added = added_spans(text, base, weights)
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + added)), len(added)))
            yield batch_of(schema, [batch.column(0), *(list(zip(*rows, strict=True)) or [()] * 7)])

    return run


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Personal data of each document's whole text.

    docs: doc_id long, text string; other columns are not read. Base spans
    (email, ip, card, phone) follow fixed patterns and always stay; counts and
    digest are theirs. A semi-Markov conditional random field adds spans that
    touch none of them: numbers are cut into digit groups, every sequence of
    at most MOST_GROUPS groups is a candidate of each kind, scored by features
    of the whole span (digits, grouping, checksum, separators, what stands
    before and around), and one dynamic programme chooses boundaries and
    kinds together. Spelt-out addresses ("name (at) host (dot) net") are
    candidates too. Its weights come from `weights` or from `trained`.

    Null or empty text: no spans, the digest of the empty string. Repeated
    rows: one row each. Null doc_id: kept. Empty table: no rows. Work is
    linear in the text, very long numbers and long lists of numbers included;
    of the candidates only those above the margin are held.
    """
    weights = trained(docs) if weights is None else weights
    bounded_batches(docs.sparkSession)
    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(
        _find(weights), f"doc_id long, {columns}, base_sha256 string, spans string, n_added long"
    )


def redacted_text(text: str, weights: np.ndarray) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, of the first kind."""
    base = base_spans(text)
    out, at = [], 0
    for start, kind, end in sorted(base + added_spans(text, base, weights)):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(weights: np.ndarray, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(name)
            column = batch.column(i)
            new = [None if x is None else redacted_text(x, weights) for x in column.to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, column.type))

    return run


def redact(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The documents, all columns kept, with the spans in text replaced by <EMAIL>, <IP>, <CARD>, <PHONE>. A null text stays null."""
    weights = trained(docs) if weights is None else weights
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_redact(weights, "text"), docs.schema)
