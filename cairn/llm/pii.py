"""Personal data by candidate boosting.

High-recall generators propose spans, which may overlap: the four base patterns and looser ones (dialling formats
without a plus, groups of digits inside longer runs that pass Luhn's check, IPv6, IBANs, e-mail addresses spelled out).
Boosted trees score each looser candidate by its format and the words before it; calibrated per-kind thresholds decide,
and of overlapping choices the best scored stays (ties: the earlier start, the longer span, the earlier kind).  Base spans
always stay.  The trees are fitted on labelled examples that this module makes from a fixed seed (EXAMPLES of them), once
on the driver; the fitted model is a few kilobytes.  The words before an example are drawn without regard to its label:
they decide only where the format leaves it open.

A null text is empty; offsets count code points, ends are exclusive.  Texts are handled whole, row by row, without a
shuffle, in time that grows with their length, however long a run without spaces is.  Repeated rows and ids and extra
columns pass through, rows without doc_id too; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Calibration
from .common import claim, load, small_batches, steps

#: Order of kinds in results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ipv6")
#: Labelled examples made for fitting.
EXAMPLES = 6000
#: Least precision wanted of each kind's threshold on the held-back examples.
PRECISION = 0.99

_run = re.compile(r"[0-9]+")
_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_loose_number = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,22}(?![A-Za-z0-9])")
_groups = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:[\x20.-]{1,2}[0-9]+)*(?![A-Za-z0-9])")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ipv6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_at = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?")
_spelled_domain = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_word = re.compile(r"[^\W\d_]+")
#: Cue words (fixed values), by what they announce.
CUES = {
    "contact": "phone tel telephone call mobile fax contact cell whatsapp telefon teléfono téléphone appel anruf llame",
    "mail": "email mail e-mail write correo courriel",
    "pay": "card visa mastercard amex credit iban account bank konto cuenta compte",
    "net": "ip host address server client login from",
    "other": "order invoice ref reference id no number total version isbn item part page chapter serial ticket build sku date year",
}
_cue = {w: k for k, ws in CUES.items() for w in ws.split()}
_cue_names = list(CUES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i & 1:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that pass the kind's check, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    # an address can only start where the run of local characters before an @ starts
    at, done = text.find("@"), 0
    while at >= 0:
        lo = max(done, at - 256)
        m = _local_end.search(text, lo, at) if at > done else None
        while m and m.start() == lo > done:
            lo = max(done, lo - 4 * (at - lo))
            m = _local_end.search(text, lo, at)
        d = _domain.match(text, at + 1) if m else None
        if d:
            out.append(("email", m.start(), d.end()))
            done = d.end()
        at = text.find("@", max(at + 1, done))
    # the digit patterns can only start at the start of a run of digits
    runs = [m.start() for m in _run.finditer(text)]
    if runs:
        if text.count(".") >= 3:
            done = 0
            for i in runs:
                if i >= done and (m := _ip.match(text, i)):
                    done = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                        out.append(("ip", i, done))
        done = 0
        for i in runs:
            if i >= done and (m := _card.match(text, i)):
                done = m.end()
                if 13 <= done - i and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    out.append(("card", i, done))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _card_groups(text: str) -> list[tuple[str, int, int]]:
    """Runs of up to six whole digit groups that hold 13 to 19 digits passing Luhn's check."""
    out = []
    for m in _groups.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [(g.start(), g.end()) for g in _run.finditer(text, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            digits = ""
            for s, e in groups[i : i + 6]:
                if len(digits) + e - s > 19:
                    break
                digits += text[s:e]
                if len(digits) >= 13 and luhn(digits):
                    out.append(("card", a, e))
    return out


def _spelled_out(text: str) -> list[tuple[str, int, int]]:
    """Addresses with (at) or [at]; a local part does not reach into the address before."""
    out, done = [], 0
    for m in _at.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _local:
            a -= 1
        d = _spelled_domain.match(text, m.end()) if a < m.start() else None
        if d:
            out.append(("email", a, d.end()))
        done = m.end()
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the looser generators; they may overlap one another and the base spans."""
    out: list[tuple[str, int, int]] = []
    if _run.search(text):
        for m in _loose_number.finditer(text):
            a = m.start()
            while a and text[a - 1] in "(+" and m.start() - a < 2:
                a -= 1
            if 7 <= len(_digits(m[0])) <= 15:
                out.append(("phone", a, m.end()))
        out += _card_groups(text)
        out += [("iban", m.start(), m.end()) for m in _iban.finditer(text)]
    if text.count(":") >= 3:
        out += [("ipv6", m.start(), m.end()) for m in _ipv6.finditer(text)]
    if "(at)" in text or "[at]" in text:
        out += _spelled_out(text)
    return out


class Taken:
    """Spans, for asking whether another one overlaps any of them."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.spans = sorted(spans)
        self.ends = list(accumulate((e for _, e in self.spans), max))

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (end,))
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        """A span that meets no other."""
        i = bisect_left(self.spans, (start, end))
        self.spans.insert(i, (start, end))
        self.ends.insert(i, end)


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 12 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    d = _digits(s)
    groups = _run.findall(s)
    before = _word.findall(text[max(0, start - 40) : start].lower())[-4:]
    cues = [_cue.get(w, "") for w in before]
    near = lambda k: max((4 - i for i, c in enumerate(reversed(cues)) if c == k), default=0)
    prev, nxt = text[start - 1 : start], text[end : end + 1]
    return [
        KINDS.index(kind), len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count("-"), s.count("."), s.count(" "), s.count("("), s.count(":"), "dot" in s, s[:1] == "+", len(d) / len(s),
        luhn(d) if d else 0, _mod97(s) if kind == "iban" else 0, prev.isalnum(), nxt.isalnum(), prev in "#$€£=/_-.", nxt in "%/_=-.",
        d[:1] == "0", len(set(d)), len(groups) == 3 and len(groups[-1]) == 4, len(groups) > 1 and len({len(g) for g in groups}) == 1,
        _run.search(text[max(0, start - 2) : start]) is not None, _run.search(text[end : end + 2]) is not None,
        *(near(k) for k in _cue_names),
    ]


FILLER = "the of and to in is that for was on are with as at by an be this from or"


def examples(n: int = EXAMPLES, seed: int = 11, filler: str = FILLER) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """(text, kind, start, end) and labels: personal data in its usual formats, and look-alikes.

    The word before the span is a cue of any sort or a filler, drawn before anything else is: it tells nothing of the
    format.  Formats that both people and machines use (bare digits, a card number beside another number) are labelled by
    that word, all others by their format alone.
    """
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = filler.split()

    def card() -> str:
        while not luhn(s := r.choice("3456") + num(r.choice((12, 14, 15, 15, 15)))):
            pass
        return s

    def iban(valid: bool) -> str:
        body, land = num(r.choice((14, 16, 18))), r.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check if valid else (check + r.randint(1, 90)) % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def chance_card() -> str:
        """A list of small numbers that some run of groups makes pass Luhn's check by chance."""
        while not _card_groups(s := r.choice((" ", ". ", "-")).join(num(r.randint(1, 7)) for _ in range(r.randint(4, 9)))):
            pass
        return s

    rows, labels = [], []
    while len(rows) < n:
        about = r.choice((None, None, *CUES))
        lead = r.choice(CUES[about].split() if about else filler)
        what, good = r.choice(("phone", "phone", "card", "iban", "ipv6", "email")), r.random() < 0.5
        if what == "phone":
            if r.random() < 0.4:  # bare digits
                s, good = r.choice((num(10), f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}")), about == "contact"
            elif good:
                s = r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}"))
            else:
                token = "".join(r.choice("0123456789abcdef") for _ in range(6))
                s = r.choice((f"{token}-{num(r.randint(7, 12))}-{token}", f"={num(r.randint(8, 12))}", f"20{num(2)}-{num(2)}-{num(2)}", num(r.choice((7, 8, 9, 11, 12, 13, 14, 15))), f"{num(1)}.{num(2)}.{num(4)}", f"{num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"))
        elif what == "card":
            s = digits = card()
            if r.random() < 0.3:  # beside another number
                s, good = f"{num(r.randint(9, 16))} {s}", about == "pay"
            elif good:
                s = r.choice(("  ", ". ", ".", "- ")).join(s[i : i + 4] for i in range(0, len(s), 4))
            else:
                s = chance_card()
        elif what == "iban":
            key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            s = iban(good) if good or r.random() < 0.5 else f"{key[:2]}{num(2)}{key}"
        elif what == "ipv6":
            s = ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if good else ":".join(num(2) for _ in range(r.choice((4, 4, 5))))
        else:
            name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 12)))
            dot = r.choice((".", ".", " (dot) ", "[dot]"))
            s = f"{name}{r.choice(('', num(2)))}{r.choice((' (at) ', '[at]'))}{r.choice(filler)}{r.choice(('', num(1)))}{dot}{r.choice((*filler, 'example', 'com'))}"
            good = dot != "." or about == "mail"
        head = " ".join(r.choice(filler) for _ in range(r.randint(0, 6))) + f" {lead}{r.choice((' ', ': ', ' '))}"
        text = f"{head}{s}{r.choice((' ', '. ', ', ', chr(10)))}{r.choice(filler)}"
        spans = [x for x in loose_spans(text) if x[0] == what and x[1] < len(head) + len(s) and x[2] > len(head)]
        base = Taken([x[1:] for x in base_spans(text)])
        spans = [x for x in spans if not base.meets(x[1], x[2])]
        if what == "card" and good:
            spans = [x for x in spans if _digits(text[x[1] : x[2]]) == digits]
        for kind, a, b in spans[:1]:
            rows.append((text, kind, a, b))
            labels.append(good)
    return rows, np.array(labels, float)


class PiiModel:
    def __init__(self) -> None:
        rows, y = examples()
        x = np.array([features(*r) for r in rows], float)
        held = np.arange(len(y)) % 3 == 0
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        raw = self.trees.raw(x[held])
        self.chance = Calibration().fit(raw, y[held])
        p, kinds = self.chance(raw), x[held, 0].astype(int)
        self.threshold = {}
        for k, name in enumerate(KINDS):
            of, truth = p[kinds == k], y[held][kinds == k]
            # the least score from which on the wanted precision holds
            self.threshold[name] = next((float(t) for t in np.unique(of) if truth[of >= t].mean() >= PRECISION and t >= 0.5), 2.0)

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """Base spans, and all spans with scores (1 for base spans)."""
        base = base_spans(text)
        held = Taken([(s, e) for _, s, e in base])
        loose = [c for c in loose_spans(text) if not held.meets(c[1], c[2])]
        chosen: list[tuple[str, int, int, float]] = []
        if loose:
            p = self.chance(self.trees.raw(np.array([features(text, *c) for c in loose], float)))
            taken = Taken()
            for score, (kind, a, b) in sorted(((float(s), c) for s, c in zip(p, loose, strict=True)), key=lambda z: (-z[0], z[1][1], -z[1][2], z[1][0])):
                if score >= self.threshold[kind] and not taken.meets(a, b):
                    taken.add(a, b)
                    chosen.append((kind, a, b, score))
        every = [(*s, 1.0) for s in base] + chosen
        return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


@lru_cache(maxsize=1)
def model() -> PiiModel:
    return PiiModel()


def _map(docs: DataFrame, schema: str, row) -> DataFrame:
    fitted = model()
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in steps(texts):
                rows = [row(fitted, i, t) for i, t in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_spans and spans as text (kind:start:end by kind, then start)."""

    def row(fitted: PiiModel, doc: int, text: str | None) -> tuple:
        base, every = fitted.spans(text or "")
        count = [sum(s[0] == k for s in base) for k in KINDS[:4]]
        say = lambda spans: ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)
        return doc, *count, say(base), say(every)

    return _map(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string", row)


def redact_text(text: str, spans: list[tuple]) -> str:
    """Each run of overlapping spans gives way to the name of its first kind in square brackets."""
    out, at, end = [], 0, -1
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            if a > at:
                out.append(text[at:a])
            out.append(f"[{kind.upper()}]")
            end = b
        end = max(end, b)
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """documents with personal data replaced by placeholders; all rows and columns stay, n_chars follows the text."""
    fitted = model()
    names = docs.columns

    def run(batches):
        claim("pii")
        for batch in batches:
            for lo, hi in steps(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = [t and redact_text(t, fitted.spans(t)[1]) for t in part.column("text").to_pylist()]
                cols = [pa.array(texts, batch.schema.field(c).type) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op2_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect(load(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
