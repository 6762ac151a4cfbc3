"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The model is trained in numpy from labelled spans, which a generator writes: the base kinds as they usually look
and as people write them to escape patterns. It reads overlapping windows of fixed size. Their scores for each
character are averaged where windows overlap, the middle of a window weighing most, and the best tags are decoded
once over all that hangs together, so that windows cannot disagree. What the model finds is kept if it holds what
its kind must hold, which for every kind is a digit, an @ or a bracketed "at" (see `sound`): a window that touches
none of these cannot hold a span that is kept, and is not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import lean, tuned

KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart: the base kinds, and secrets (keys, tokens, passwords), which have a column of their own.
TOLD, SECRET = (*KINDS, "secret"), 4
#: Window and step in characters, and windows that are scored at once.
WINDOW, STEP, AT_ONCE = 96, 48, 512
#: Sizes of the character vectors and of each direction's state.
EMBED, HIDDEN = 16, 32
#: Training: examples, steps, examples a step, rate. The examples are generated; these bounds do not depend on the input.
EXAMPLES, STEPS, BATCH, RATE = 8000, 700, 48, 0.01

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_AT = re.compile(r"@|[\[(]\s*at\s*[\])]", re.I)
_OPENS = re.compile(rf"[0-9]|{_AT.pattern}", re.I)
_DIGITS = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, in order of start, then of kind; leftmost, not overlapping in a kind, failures dropped."""
    out: list[Span] = []
    if not _SIGN.search(text):
        return out
    at, last = text.find("@"), 0
    while at >= 0:  # from each @ outwards: a search from the left would try every run of letters
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, last := m.end()))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def as_text(spans: list[Span]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{TOLD[k]}:{s}:{e}" for s, k, e in spans)


# --- labelled spans ---------------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice("the an er on in re ti es or en at ou ed ing ver ung que ción lle mar to li sa ne ko du pé schü ña".split()) for _ in range(r.randint(1, 3)))


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random) -> str:
    digits = _number(r, r.choice([13, 14, 15, 15, 15, 16]))
    digits = next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
    gap = r.choice(["", "", " ", "-", ".", "/", "  "])
    return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _email(r: random.Random) -> str:
    at = r.choice(["@", "@", "@", " @ ", "(at)1", " [at] ", " (at) "]).replace("(at)1", "(at)")
    dot = "." if at == "@" else r.choice([".", " . ", " [dot] ", "(dot)", " dot "])
    plain = lambda: "".join(c for c in _word(r) if c.isascii())  # noqa: E731  the base pattern's addresses are ASCII
    user = plain() + r.choice(["", ".", "_", "-"]) + r.choice([plain(), _number(r, r.randint(1, 3))])
    return user + at + plain() + r.choice(["", _number(r, 1)]) + dot + r.choice(["example" + dot, ""]) + r.choice("com org net de fr es io".split())


def _ip(r: random.Random) -> str:
    dot = r.choice([".", ".", ".", " . ", "[.]", "(.)"])
    return dot.join(str(r.randint(0, 255)) for _ in range(4))


def _phone(r: random.Random) -> str:
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    lead = r.choice(["+1 ", "+" + _number(r, 2) + " ", "00" + _number(r, 2) + " ", "1-", "", ""])
    return lead + r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"])


def _secret(r: random.Random) -> tuple[str, str, str]:
    """A secret with what stands before and after it."""
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda some, n: "".join(r.choice(some) for _ in range(n))
    name = r.choice("token key secret password api_key access_token auth client_secret TOKEN SECRET_KEY".split())
    value = r.choice([lambda: draw(hexes, r.choice([32, 40, 40, 64])), lambda: draw(letters, r.randint(20, 44)), lambda: "AKIA" + draw(letters[:26] + letters[52:], 16),
                      lambda: "ghp_" + draw(letters, 36), lambda: "sk-" + draw(letters, r.choice([32, 48])), lambda: draw(letters + "+/", r.randint(24, 40)) + "="])()
    before, after = r.choice([('"', '"'), ("'", "'"), ("", "")])
    return name + r.choice([" = ", "=", ": ", ":", " is ", " := "]) + before, value, after


def _other(r: random.Random) -> str:
    return r.choice([
        lambda: r.choice(["token ", "the key ", "a secret "]) + _word(r), lambda: "Version " + f"{r.randint(0, 9)}.{r.randint(0, 20)}",
        lambda: str(r.randint(1900, 2099)), lambda: f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{_number(r, r.randint(1, 7))}",
        lambda: f"${r.randint(1, 999)}.{_number(r, 2)}", lambda: f"{r.randint(0, 23)}:{_number(r, 2)}", lambda: "@" + _word(r), lambda: "CC BY-NC 4.0", lambda: f"{r.randint(1, 99)}%",
    ])()


def example(r: random.Random) -> tuple[str, list[Span]]:
    """A text with its labelled spans."""
    makers, text, spans = (_email, _ip, _card, _phone), "", []
    for _ in range(r.randint(2, 5)):
        text += " ".join(_word(r) for _ in range(r.randint(1, 6))) + r.choice([" ", " ", " ", ". ", ": ", ", ", "\n", " ("])
        kind = r.randint(0, 6)
        after = ""
        if kind == SECRET:
            before, piece, after = _secret(r)
            text += before
        else:
            piece = makers[kind](r) if kind < len(makers) else _other(r)
        if kind <= SECRET:
            spans.append((len(text), kind, len(text) + len(piece)))
        text += piece + after + r.choice([" ", " ", ". ", ", ", ") ", ".\n", "$$$ "])
    return text, spans


# --- the model --------------------------------------------------------------------------------------------------

_CODES = {c: i + 2 for i, c in enumerate(" \n.,-+()@[]/:;=\"'_%$#&*!?0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}
SYMBOLS = len(_CODES) + 2  # 0 stands for what lies outside the text, 1 for any other character
TAGS = 1 + 2 * len(TOLD)  # outside; first and further characters of each kind
_TABLE = np.ones(128, np.int64)
for _c, _i in _CODES.items():
    _TABLE[ord(_c)] = _i


def codes(text: str) -> np.ndarray:
    """The symbol of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], 1)


def tags(n: int, spans: list[Span]) -> np.ndarray:
    """The tag of each of n characters."""
    out = np.zeros(n, np.int64)
    for s, k, e in spans:
        out[s:e] = 2 + 2 * k
        out[s] = 1 + 2 * k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction over time-major input; keep: also what the way back needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype)
    ahead = x @ w[:EMBED] + w[-1]
    out, seen = np.empty((steps, batch, HIDDEN), x.dtype), []
    for t in range(steps):
        z = ahead[t] + h @ w[EMBED:-1]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            seen.append((h, c, i, f, o, g, tc))
        h, c = o * tc, new
        out[t] = h
    return out, seen


def _lstm_back(x: np.ndarray, w: np.ndarray, seen: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, dx = np.zeros_like(w), np.empty_like(x)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = seen[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw[:EMBED] += x[t].T @ dz
        dw[EMBED:-1] += h.T @ dz
        dw[-1] += dz.sum(0)
        dx[t] = dz @ w[:EMBED].T
        dh, dc = dz @ w[EMBED:-1].T, dc * f
    return dx, dw


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Tag scores (batch, characters, tags) of windows of symbols (batch, characters)."""
    e = p["embed"][x.T]
    a, _ = _lstm(e, p["right"], False)
    b, _ = _lstm(e[::-1], p["left"], False)
    return (np.concatenate([a, b[::-1]], 2) @ p["out"][:-1] + p["out"][-1]).transpose(1, 0, 2)


def _sumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _loss(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of the tag sequences under the CRF, and its gradients."""
    e = p["embed"][x.T]
    a, sa = _lstm(e, p["right"], True)
    b, sb = _lstm(e[::-1], p["left"], True)
    h = np.concatenate([a, b[::-1]], 2)
    s, tr = h @ p["out"][:-1] + p["out"][-1], p["moves"]
    steps, batch = s.shape[:2]
    fw, bw = np.empty_like(s), np.zeros_like(s)
    fw[0] = s[0]
    for t in range(1, steps):
        fw[t] = _sumexp(fw[t - 1][:, :, None] + tr, 1) + s[t]
    for t in range(steps - 2, -1, -1):
        bw[t] = _sumexp(tr + (bw[t + 1] + s[t + 1])[:, None, :], 2)
    z = _sumexp(fw[-1], 1)
    ds = np.exp(fw + bw - z[:, None])
    dtr = np.zeros_like(tr)
    for t in range(1, steps):
        dtr += np.exp(fw[t - 1][:, :, None] + tr + (s[t] + bw[t])[:, None, :] - z[:, None, None]).sum(0)
    rows, yt = np.arange(batch), y.T
    gold = 0.0
    for t in range(steps):
        gold += s[t, rows, yt[t]].sum()
        ds[t, rows, yt[t]] -= 1
        if t:
            gold += tr[yt[t - 1], yt[t]].sum()
            np.subtract.at(dtr, (yt[t - 1], yt[t]), 1)
    dh = ds @ p["out"][:-1].T
    dout = np.concatenate([np.tensordot(h, ds, ((0, 1), (0, 1))), ds.sum((0, 1))[None]])
    dx, dright = _lstm_back(e, p["right"], sa, dh[:, :, :HIDDEN])
    dx2, dleft = _lstm_back(e[::-1], p["left"], sb, np.ascontiguousarray(dh[::-1, :, HIDDEN:]))
    dembed = np.zeros_like(p["embed"])
    np.add.at(dembed, x.T, dx + dx2[::-1])
    grads = {"embed": dembed, "right": dright, "left": dleft, "out": dout, "moves": dtr}
    return float((z.sum() - gold) / batch), {k: g / batch for k, g in grads.items()}


def windows(r: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n training windows of generated texts, cut anywhere, with their tags."""
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = example(r)
        at = r.randint(-8, max(0, len(text) - WINDOW // 2))
        x, y = codes(text), tags(len(text), spans)
        lo = max(0, at)
        m = min(len(text), at + WINDOW) - lo
        xs[i, lo - at : lo - at + m], ys[i, lo - at : lo - at + m] = x[lo : lo + m], y[lo : lo + m]
    return xs, ys


@lru_cache(maxsize=2)
def trained(seed: int = 5, steps: int = STEPS) -> dict[str, np.ndarray]:
    """The trained parameters; the same for the same seed."""
    g, r = np.random.default_rng(seed), random.Random(seed)
    make = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"embed": make(SYMBOLS, EMBED) * 3, "right": make(EMBED + HIDDEN + 1, 4 * HIDDEN), "left": make(EMBED + HIDDEN + 1, 4 * HIDDEN), "out": make(2 * HIDDEN + 1, TAGS), "moves": make(TAGS, TAGS)}
    for side in ("right", "left"):
        p[side][-1] = 0
        p[side][-1, HIDDEN : 2 * HIDDEN] = 1
    xs, ys = windows(r, EXAMPLES)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = g.integers(0, len(xs), BATCH)
        _, grads = _loss(p, xs[pick], ys[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k, v in grads.items():
            v = v * min(1, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best tag sequence for each table of scores (characters, tags), all at once."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for lo in range(0, len(order), 256):
        some = order[lo : lo + 256]
        sizes = np.array([len(scores[i]) for i in some])
        steps = int(sizes[0])
        table = np.zeros((steps, len(some), TAGS), np.float32)
        for j, i in enumerate(some):
            table[: len(scores[i]), j] = scores[i]
        best, back = table[0], np.zeros((steps, len(some), TAGS), np.int8)
        finals = np.zeros(len(some), np.int64)
        for t in range(1, steps + 1):
            ended = sizes == t
            finals[ended] = best[: len(some)][ended].argmax(1)
            if t == steps:
                break
            ways = best[:, :, None] + moves
            back[t] = ways.argmax(1)
            best = ways.max(1) + table[t]
        for j, i in enumerate(some):
            path = np.zeros(sizes[j], np.int64)
            path[-1] = finals[j]
            for t in range(sizes[j] - 1, 0, -1):
                path[t - 1] = back[t, j, path[t]]
            out[i] = path
    return out


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def model_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[list[Span]]:
    """What the model tags in each text, over windows that overlap by half."""
    symbols, places = [codes(t) for t in texts], []
    for i, t in enumerate(texts):
        at = np.array([x for m in _OPENS.finditer(t) for x in (m.start(), m.end() - 1)], np.int64)
        if len(at):
            k = np.unique(np.concatenate([at // STEP, at // STEP - 1]))
            places += [(i, int(j)) for j in k]
    runs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # text, start, summed scores, summed weights
    for lo in range(0, len(places), AT_ONCE):
        some = places[lo : lo + AT_ONCE]
        x = np.zeros((len(some), WINDOW), np.int64)
        for j, (i, k) in enumerate(some):
            s, e = max(0, k * STEP), min(len(symbols[i]), k * STEP + WINDOW)
            x[j, s - k * STEP : e - k * STEP] = symbols[i][s:e]
        scores = emissions(p, x) * _WEIGHT[None, :, None]
        for j, (i, k) in enumerate(some):
            start = k * STEP
            if not runs or runs[-1][0] != i or start >= runs[-1][1] + len(runs[-1][3]):
                runs.append((i, start, scores[j].copy(), _WEIGHT.copy()))
            else:
                _, first, total, weight = runs[-1]
                shift = start - first
                more = shift + WINDOW - len(weight)
                total, weight = np.concatenate([total, np.zeros((more, TAGS), np.float32)]), np.concatenate([weight, np.zeros(more, np.float32)])
                total[shift:] += scores[j]
                weight[shift:] += _WEIGHT
                runs[-1] = (i, first, total, weight)
    found: list[list[Span]] = [[] for _ in texts]
    for (i, start, _, _), path in zip(runs, decode([total / weight[:, None] for _, _, total, weight in runs], p["moves"]), strict=True):
        at, n = 0, len(path)
        while at < n:
            if path[at] == 0:
                at += 1
                continue
            kind, end = (path[at] - 1) // 2, at + 1
            while end < n and path[end] == 2 + 2 * kind:
                end += 1
            s, e = max(0, start + at), min(len(texts[i]), start + end)
            if s < e:
                found[i].append((s, int(kind), e))
            at = end
    return found


_DOT = re.compile(r"\.|[\[(]\s*dot\s*[\])]|\sdot\s", re.I)


def sound(text: str, span: Span) -> Span | None:
    """A model's span, trimmed, if it holds what its kind must hold; else None."""
    s, k, e = span
    while s < e and not text[s].isalnum() and text[s] not in "+(":
        s += 1
    while e > s and not text[e - 1].isalnum() and not (k == SECRET and text[e - 1] == "="):
        e -= 1
    body = text[s:e]
    digits = _DIGITS.sub("", body)
    if k == 0:
        sides = _AT.split(body)
        ok = len(sides) == 2 and re.search(r"\w", sides[0]) is not None and _DOT.search(sides[1]) is not None and re.search(r"[A-Za-z]{2,}\s*$", sides[1]) is not None and len(body) <= 80 and body.count(" ") <= 8
    elif k == 1:
        parts = re.findall(r"[0-9]+", body)
        ok = len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and re.fullmatch(r"[0-9]+(?:\s?[\[(]?\.[\])]?\s?[0-9]+){3}", body) is not None
    elif k == SECRET:
        ok = len(body) >= 16 and re.fullmatch(r"[A-Za-z0-9_+/.-]+=*", body) is not None and digits != "" and digits != body and len(set(body)) >= 8
    elif k == 2:
        ok = 14 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9][0-9 ./-]*", body) is not None
    else:
        ok = 10 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*", body) is not None and not digits == body
    if not ok or s and text[s - 1].isalnum() and k or e < len(text) and text[e].isalnum():
        return None
    return s, k, e


def all_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: the model adds what touches no base span and is sound."""
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, more in zip(texts, base, model_spans(texts, p), strict=True):
        spans = list(own)
        for span in more:
            good = sound(text, span)
            if good and all(good[2] <= s or e <= good[0] for s, _, e in spans):
                spans.append(good)
        out.append((own, sorted(spans)))
    return out


def find_personal(docs: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets, n_found for each document.

    Counts and base_sha256 are of the base spans; spans lists all of the four kinds, kind:start:end by start,
    then kind; n_added is how many of them the model added, secrets lists the keys, tokens and passwords that it
    found, n_found counts everything. Null and empty texts have none. Offsets are code points, ends
    exclusive. Equal texts give equal values; repeated rows each give a row. Other columns are not read.
    """
    tuned(docs.sparkSession)
    p = trained(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = all_spans(texts, p)
            counts = [pa.array([sum(k == i for _, k, _ in own) for own, _ in rows], pa.int64()) for i in range(4)]
            digests = pa.array([hashlib.sha256(as_text(own).encode()).hexdigest() for own, _ in rows], pa.string())
            secret = [[x for x in s if x[1] == SECRET] for _, s in rows]
            told = [[x for x in s if x[1] != SECRET] for _, s in rows]
            added = pa.array([len(s) - len(own) for s, (own, _) in zip(told, rows, strict=True)], pa.int64())
            texts_of = lambda some: pa.array([as_text(x) for x in some], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, texts_of(told), added, texts_of(secret), pa.array([len(s) for _, s in rows], pa.int64())], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "secrets", "n_found"]
    kinds = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans', 'secrets') else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), kinds)
