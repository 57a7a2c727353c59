"""Personal data in texts: exact patterns, and a linear-chain CRF over word shapes for what they miss."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, slices

#: The base kinds, in order; the model adds spans of these and of the last one.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn")
TAGS = ("O", *KINDS)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match always begins with its run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_SIGN = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_LETTER = re.compile(r"[^\W\d_]")
_JOINT = re.compile(r"(?<=\S)[,;|/](?=\S)")
MOST_DIGITS = 19


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from their @ (linear in the text)."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", max(floor, at + 1))


def loaded(text: str) -> Iterator[tuple[int, int]]:
    """[start, stop) of the words that hold a digit or @, grown from that sign to the blanks around it (linear in the text)."""
    at = 0
    while sign := _SIGN.search(text, at):
        start = sign.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, sign.end())
        at = blank.start() if blank else len(text)
        yield start, at


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, 1) of all base matches, in order."""
    out = [(a, 0, b, 1) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), 1))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end(), 1))
    return sorted(out)


def shape(word: str) -> str:
    """Letters as x or X (runs as one), digits as d (each one, up to 5 of a run), other signs as they are."""
    s = re.sub(r"[A-Z]+", "X", re.sub(r"[a-z]+|[^\x00-\x7F]+", "x", word))
    return re.sub(r"d{6,}", "dddddd", re.sub(r"[0-9]", "d", s))[:24]


_HEX_GROUPS = re.compile(r"[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){2,}")


_ADDRESS = re.compile(r"[^\s@<>()\[\]\"',;:/\\]+@([^\W_]([\w-]*[^\W_])?\.)+[^\W\d_]{2,}")


#: Words of a run to each side that a word's features look at.
RUN_WORDS = 6


def _said(word: str) -> str:
    """A word of a context: itself, or its shape where it may be personal data, so that no number is learnt by heart."""
    return shape(word) if _SIGN.search(word) else word.lower()[:12]


def token_features(words: list[str], k: int) -> list[str]:
    """Names of the features of word k: its shape and its neighbours', and the two words before it."""
    own = shape(words[k])
    digits = sum(c.isdigit() for c in words[k])
    first = last = k
    while first and k - first < RUN_WORDS and _SIGN.search(words[first - 1]):
        first -= 1
    while last + 1 < len(words) and last - k < RUN_WORDS and _SIGN.search(words[last + 1]):
        last += 1
    run = words[first : last + 1]
    zero = "".join(run).lstrip("(+").startswith("0")
    before = shape(words[k - 1]) if k else "^"
    after = shape(words[k + 1]) if k + 1 < len(words) else "$"
    return [
        f"s={own}", f"n={min(digits, 20)}", f"c={re.sub(r'd+', 'd', own)}", f"l={digits == len(words[k])}", f"@={'@' in words[k]}",
        f"p={before}|{own}", f"f={own}|{after}", f"w={_said(words[k - 1]) if k else ''}", f"v={_said(words[k - 2]) if k > 1 else ''}",
        f"t={min(sum(len(_DIGIT.findall(w)) for w in run), 20)}|{zero}", f"z={zero}|{len(run)}", f"r={' '.join(re.sub('d+', 'd', shape(w)) for w in run)[:40]}",
        f"a={'@' in words[k] and _ADDRESS.fullmatch(words[k]) is not None}",
        f"g={_HEX_GROUPS.fullmatch(words[k]) is not None and ('::' in words[k] or words[k].count(':') == 7)}",
    ]


#: A small labelled table: words, each with its tag behind a bar where it isn't O.
LABELLED = """
write to ana.m@mail.example.org|email today
contact bob_7@shop.example.com|email or call (724)|phone 555-7058|phone now
call +1|phone (988)|phone 555-2485|phone after nine
phone 415-555-0132|phone please
tel 415.555.0199|phone office
our number is (212)|phone 555-0101|phone here
fax 303-555-0177|phone and mail
reach me at +44|phone 20|phone 7946|phone 0958|phone soon
mobile 646-555-0110|phone or home 646-555-0111|phone
the host 192.168.0.12|ip failed
ping 10.0.0.1|ip and 172.16.4.9|ip first
from 8.8.8.8|ip to here
card 4111111111111111|card was used
paid with 5500000000000004|card yesterday
number 4111|card 1111|card 1111|card 1111|card expires
card 4000-0566-5566-5556|card is old
ssn 123-45-6789|ssn on file
social security 987-65-4321|ssn was seen
her ssn is 219-09-9999|ssn now
id 078-05-1120|ssn found
in 1999 there were 12 of them
the price was 12.50 or 1,200 then
on 2020-01-02 at 12:30 we met
on 01/02/2020 or 2.1.2020 they left
version 1.2.3 and v2.0 came out
about 3.5 % of 1024 bytes
page 12-14 and lines 100-200
order 1234567 has 40 items
born 12-03-1985 in town
section 4.2.1 covers 10 cases
key b7db7aa4a5fcc783 and 9f3c were lost
password=b7db7aa4a5fcc78305 was kept
token = 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae here
scale 1024x768 or 16:9 fits
the 1st and 22nd of 365 days
room 101 floor 7 building 3
isbn 978-3-16-148410-0 in print
code 12345-6789 is a place
3 4 5 6 7 and so on
5 10 15 20 25 30 rows
user@host said hi
see @name and #42
year 1984-1985 was 2 long
batch 20200102123000 ran
lot 123456789 left 55 behind
dial 628-555-0143|phone before 5 pm
you can text 312.555.0178|phone any day
cell (503)|phone 555-0121|phone or fax (503)|phone 555-0122|phone
whatsapp +49|phone 30|phone 901820|phone is open
the number 917-555-0166|phone was 2 digits off
his ssn 401-22-7788|ssn and card 4242424242424242|card
tax id 512-63-1199|ssn of the owner
charged 3714|card 496353|card 98431|card twice
visa 4242|card 4242|card 4242|card 4242|card declined
mail jo_9@b.example.net|email or admin@x9.example.io|email
server 172.31.255.4|ip and 192.0.2.77|ip answered
from 1.5 to 2.75 of 10.25
at 09:15:30 on 2021-11-05T09:15:30Z
sku 4021-8837-12 and part 77-1203
invoice 2023-000451 of 1,250.00
call 911 or 112 at once
score 3-2 then 10-12 and 7:5
from 1914-18 to 1939-45 in 2 parts
flight 1234 gate 22 seat 14
lines 415-420 of 555 and 0132
page 123-456 of volume 7890
dial 212|phone 555|phone 0147|phone after noon
phone 303|phone 555|phone 0186|phone or 720|phone 555|phone 0102|phone
my cell is 617|phone 555|phone 0119|phone thanks
please text 917|phone 5550|phone 143|phone now
call 0171|phone 946|phone 0123|phone in london
ring 0131|phone 496|phone 0770|phone today
telephone 01632|phone 960|phone 983|phone at home
rufen sie 040/4711289|phone an
tel 089/1234567|phone office
fon 0221/4703311|phone abends
telefon 0211/8765432|phone oder fax 0211/8765433|phone
tel 0341-9604411|phone jetzt
appelez 01|phone 99|phone 00|phone 12|phone 34|phone demain
tel 06.39.98.76.54|phone merci
llame al 091|phone 555|phone 0123|phone hoy
mobile 07700|phone 900|phone 461|phone please
ring +44-20-7946-0958|phone or +1.212.555.0147|phone
phone number (0)20|phone 7946|phone 0018|phone here
call 1-800-555-0100|phone toll free
fax 1|phone 800|phone 555|phone 0155|phone free
ssn 219|ssn 09|ssn 9999|ssn on record
her social security number is 401|ssn 22|ssn 7788|ssn and
my ssn was 512|ssn 63|ssn 1199|ssn once
ssn: 078|ssn 05|ssn 1120|ssn leaked
social 331-20-4456|ssn belongs to him
his ssn is 457|ssn 55|ssn 5462|ssn today
and the ssn is 601|ssn 17|ssn 3048|ssn for now
an ssn of 219|ssn 09|ssn 9998|ssn was sold
ssn no 078|ssn 05|ssn 1121|ssn
host 2001:0db8:85a3:0000:0000:8a2e:0370:7335|ip answered
server 2001:0db8:0000:0042:0000:8a2e:0370:7336|ip up
write to josé@correo.example.es|email or rené.k@poste.example.fr|email
mail an jörg@büro.example.de|email bitte
send it to ana@müller.example.org|email soon
email søren7@firma.example.dk|email today
send øyvind@fjord.example.no|email a letter
reply to łukasz@poczta.example.pl|email please
from nuño@casa.example.es|email to me
cc zoé@maison.example.be|email and chloé@maison.example.be|email
host 2001:db8::1|ip failed
server fe80::1ff:fe23:4567:890a|ip is up
from 2001:db8:85a3:0:0:8a2e:370:7334|ip to 2001:db8::42|ip now
ping ::1|ip once
route to 2001:db8:44::f00d:7|ip is down
it came over fd12:3456:789a::1|ip again
peer 2a02:8108:9c0::42|ip left
2001:db8:0:7::abcd|ip denied
blocked fe80::a1b2|ip and c0de:beef::4d2|ip
address fd00:1:2::3|ip in use
you can call 628|phone 555|phone 0173|phone at noon
under 503|phone 555|phone 0166|phone until 5 pm
312|phone 555|phone 0128|phone
number 415|phone 555|phone 0190|phone
line 646|phone 555|phone 0134|phone is free
her phone, 718|phone 555|phone 0111|phone she said
cell 415/555-0132|phone or 212/555-0177|phone
office 212.555|phone 0166|phone daily
under 05|phone 61|phone 33|phone 20|phone 11|phone please
06|phone 12|phone 34|phone 56|phone 78|phone
line 04|phone 76|phone 54|phone 32|phone 10|phone is free
old 4242424242424242|card 5555555555554444|card new
text. 6011111111111117|card 4012888888881881|card words
cards 378282246310005|card 4000056655665556|card both
total of 043 78 0921 units
sold 100 200 3000 units and 212 400 5000 more
got 310 220 4000 votes
list 078 05 1120 items
file 0123/4567890 moved
rows 100 200 3000 and 415 of it
sizes 120 450 1200 mm wide
in 1990 1995 2000 and 2005 they won
about 300 400 5000 people came
scores 212 303 4040 were seen
matrix 123 45 6789 is printed
sum of 123 45 6789 items
values 020 040 0600 in hex
numbers 617 917 5000 are codes
from 100 to 250 or 1000 rows
ratio 3/4 and 15/16 of 030/12
serial 12/345678 of batch 44/2020
file 2020/0012345 was closed
case 0211/2019 and docket 12/00456
date 01/02/2020 and 2020/01/02
time 12:30:15 and 09:15 or 00:00:01
mac 00:1b:44:11:3a:b7 of card
a::b and std::vector2 in code
ratio 16:9:4 and 1:2:3:4
handle me@home1 and you@work2
git@host7 and root@db1 log in
5@3 or 7@9 each
counts 01 02 03 04 05 listed
digits 12 34 56 78 90 shown
steps 07 08 09 10 11 done
isbn 0 306 40615 2 in print
zip 90210 1234 and 10001 5678
track 0341 of 9604411 tracks
"""


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in LABELLED.strip().splitlines():
        pairs = [w.rsplit("|", 1) if "|" in w else (w, "O") for w in line.split()]
        rows.append(([w for w, _ in pairs], [TAGS.index(t) for _, t in pairs]))
    return rows


@dataclass
class ShapeCRF:
    """Weights of a linear-chain CRF; words without a digit or @ are always O."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    _memo: dict = field(default_factory=dict)

    def scores(self, words: list[str], k: int) -> np.ndarray:
        names = tuple(token_features(words, k))
        if names not in self._memo:
            if len(self._memo) > 100_000:
                self._memo.clear()
            at = [self.index[f] for f in names if f in self.index]
            self._memo[names] = self.emit[at].sum(0) if at else np.zeros(len(TAGS))
        return self._memo[names]

    def viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of many runs of scored words at once; each run stands between words tagged O."""
        order = np.argsort([-len(r) for r in runs], kind="stable")
        lengths = np.array([len(runs[i]) for i in order], np.int64)
        if not len(runs):
            return []
        best = self.move[0] + np.stack([runs[i][0] for i in order])
        back = []
        for t in range(1, int(lengths[0])):
            n = int((lengths > t).sum())
            path = best[:n, :, None] + self.move
            back.append(path.argmax(1))
            step = path.max(1) + np.stack([runs[i][t] for i in order[:n]])
            best = np.concatenate([step, best[n:]])
        last = (best + self.move[:, 0]).argmax(1)
        out: list = [None] * len(runs)
        for k, i in enumerate(order):
            tags = np.empty(lengths[k], np.int64)
            tags[-1] = last[k]
            for t in range(int(lengths[k]) - 1, 0, -1):
                tags[t - 1] = back[t - 1][k, tags[t]]
            out[i] = tags
        return out


def train(rows: list[tuple[list[str], list[int]]] | None = None, *, epochs: int = 60, rate: float = 0.1, l2: float = 1e-3, drop: float = 0.35) -> ShapeCRF:
    """Weights that maximise the labelled rows' likelihood (forward-backward gradients, Adam); always the same.

    In each step a share `drop` of the features is left out, so that no tag hangs on one exact shape.
    """
    rng = np.random.default_rng(7)
    rows = rows or labelled_rows()
    named = [[token_features(words, k) for k in range(len(words))] for words, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for r in named for t in r for f in t}))}
    k = len(TAGS)
    theta = np.zeros((len(index) + k, k))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    free = [np.array([bool(_SIGN.search(w)) for w in words]) for words, _ in rows]
    ids = [[np.array([index[f] for f in t]) for t in r] for r in named]
    for step in range(1, epochs + 1):
        grad = -l2 * theta
        emit, move = theta[: len(index)], theta[len(index) :]
        for (_, tags), whole, open_ in zip(rows, ids, free, strict=True):
            at = [i[rng.random(len(i)) >= drop] for i in whole]
            e = np.stack([emit[i].sum(0) for i in at])
            e[~open_, 1:] = -1e4
            n = len(e)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = e[0]
            for t in range(1, n):
                a[t] = e[t] + np.logaddexp.reduce(a[t - 1][:, None] + move, axis=0)
            for t in range(n - 2, -1, -1):
                b[t] = np.logaddexp.reduce(move + (e[t + 1] + b[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(a[-1])
            p = np.exp(a + b - z)
            for t in range(n):
                if open_[t]:
                    grad[at[t], tags[t]] += 1
                    grad[at[t]] -= p[t]
                if t:
                    pair = np.exp(a[t - 1][:, None] + move + (e[t] + b[t])[None] - z)
                    grad[len(index) :] -= pair
                    grad[len(index) + tags[t - 1], tags[t]] += 1
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return ShapeCRF(index, theta[: len(index)], theta[len(index) :])


_SSN = re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}")


def _plausible(kind: int, piece: str) -> bool:
    """What a decoded span must be to count: enough digits of its kind, a whole address.

    A phone number of 9 digits begins with 0 and is parted; an ip is one of version 6, as the others are base matches.
    """
    if KINDS[kind] == "email":
        return len(piece) <= 254 and _ADDRESS.fullmatch(piece) is not None
    if KINDS[kind] == "ip":
        try:
            return 2 < len(piece) <= 45 and ":" in piece and bool(ipaddress.IPv6Address(piece))
        except ValueError:
            return False
    digits = "".join(_DIGIT.findall(piece))
    if KINDS[kind] == "phone":
        return len(digits) in range(10, 16) or (len(digits) == 9 and piece.lstrip("(")[0] == "0" and not piece.isdigit())
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return _SSN.fullmatch(piece.strip("().,;:")) is not None


def _cut_run(kind: int, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The plausible pieces of a run of words of one tag: most words covered, fewest list marks inside, most pieces.

    A list mark is a line feed or other sign between two words, or a ( or + that opens the second. A piece of several words has no letters.
    """
    if len(spans) == 1:
        return spans if _plausible(kind, text[spans[0][0] : spans[0][1]]) else []
    digits = [len(_DIGIT.findall(text[a:b])) for a, b in spans]
    mark = [False] + [bool(text[x:y].strip(" \t")) or text[y] in "(+" for (_, x), (y, _) in zip(spans, spans[1:], strict=False)]
    best: list[tuple[tuple[int, int, int], int]] = [((0, 0, 0), 0)] * (len(spans) + 1)  # of the words from k: what counts, and where a piece from k stops (0: none)
    for k in range(len(spans) - 1, -1, -1):
        best[k] = (best[k + 1][0], 0)
        n = marks = 0
        for j in range(k, len(spans)):
            n += digits[j]
            marks += mark[j] and j > k
            if n > MOST_DIGITS or not digits[j]:
                break
            if _plausible(kind, piece := text[spans[k][0] : spans[j][1]]) and not (j > k and _LETTER.search(piece)):
                rest = best[j + 1][0]
                best[k] = max(best[k], ((rest[0] + j + 1 - k, rest[1] - marks, rest[2] + 1), j + 1))
    out, k = [], 0
    while k < len(spans):
        stop = best[k][1]
        if stop:
            out.append((spans[k][0], spans[stop - 1][1]))
        k = stop or k + 1
    return out


def _parts(word: str) -> Iterator[tuple[int, int]]:
    """[start, stop) of the words that commas and the like join without a space, where one of them is plausible alone."""
    cuts = [] if "://" in word else [m.start() for m in _JOINT.finditer(word)]
    pieces = list(zip([0, *(c + 1 for c in cuts)], [*cuts, len(word)], strict=True))
    if cuts and any(_plausible(kind, word[a:b]) for a, b in pieces for kind in range(len(KINDS))):
        yield from ((a, b) for a, b in pieces if _SIGN.search(word, a, b))
    else:
        yield 0, len(word)


def model_spans(texts: list[str | None], known: list[list[tuple[int, int, int, int]]], model: ShapeCRF) -> list[list[tuple[int, int, int, int]]]:
    """(start, kind number, end, 0) of each text's decoded spans; words that touch its `known` spans part them."""
    runs, places = [], []
    for r, text in enumerate(texts):
        if not text or not (_DIGIT.search(text) or "@" in text):
            continue
        last, words, spans = -1, [], []

        def close(r=r):
            nonlocal words, spans
            if spans:
                first = len(words) - 1 - len(spans)
                runs.append(np.stack([model.scores(words, k + first) for k in range(len(spans))]))
                places.append((r, spans))
            words, spans = [], []

        for start, stop in loaded(text):
            # two words before and the one behind a run of loaded words are its context
            if last < 0 or not text[last:start].isspace():
                if spans:
                    words.append((_TOKEN.search(text, last) or _TOKEN.search(text, start)).group().rstrip(".,;:!?"))
                    close()
                before = text[max(0, start - 40) : start].split()
                words = [w.rstrip(".,;:!?") for w in before[-2:]]
            core = text[start:stop].rstrip(".,;:!?")
            for a, b in _parts(core):
                words.append(core[a:b])
                spans.append((start + a, start + b))
            last = stop
        if spans:
            behind = _TOKEN.search(text, last)
            words.append(behind.group().rstrip(".,;:!?") if behind else "")
            close()
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for (r, spans), tags in zip(places, model.viterbi(runs), strict=True):
        taken = known[r]
        starts, ends = [a for a, *_ in taken], list(accumulate((b for _, _, b, _ in taken), max))

        def touches(a, b, starts=starts, ends=ends):
            """Whether one of the sorted spans overlaps [a, b): of those that begin before b, the one that ends last."""
            k = bisect_left(starts, b)
            return k > 0 and ends[k - 1] > a

        free = [not touches(a, b) for a, b in spans] if taken else [True] * len(spans)
        t = 0
        while t < len(tags):
            stop = t + 1
            while stop < len(tags) and tags[stop] == tags[t] and free[stop] == free[t]:
                stop += 1
            if tags[t] and free[t]:
                kind = int(tags[t]) - 1
                out[r] += [(a, kind, b, 0) for a, b in _cut_run(kind, texts[r], spans[t:stop]) if not touches(a, b)]
            t = stop
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("no", pa.int32()), ("stop", pa.int64()), ("base", pa.int32())]))


def _found(texts: list[str | None], model: ShapeCRF) -> list[list[tuple[int, int, int, int]]]:
    known = [base_spans(t) if t else [] for t in texts]
    return [sorted(a + b) for a, b in zip(known, model_spans(texts, known, model), strict=True)]


def scan_pii(docs: DataFrame, model: ShapeCRF | None = None) -> DataFrame:
    """(doc_id, spans) of each row of docs(doc_id, text).

    spans: structs (start, no, stop, base) in code points, stop exclusive, sorted; no
    numbers KINDS; base is 1 for pattern matches and 0 for the model's additions,
    which touch none of the former.

    Defined results: a null text is empty and has no spans; null and repeated doc_ids
    are scanned row by row; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = _found(part.column("text").to_pylist(), shared.value)
            spans = pa.array([[dict(zip(("start", "no", "stop", "base"), s, strict=True)) for s in r] for r in rows], _SPAN)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans], ["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<start:bigint,no:int,stop:bigint,base:int>>")


def redact(docs: DataFrame, model: ShapeCRF | None = None) -> DataFrame:
    """docs with each span of its column text replaced by <KIND> (touching spans by the first one's); other columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def clean(text: str | None, spans) -> str | None:
        out, at = [], 0
        for a, kind, b, _ in spans:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], f"<{KINDS[kind].upper()}>"]
            at = b
        return text if not out else "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            new = pa.array([clean(t, s) for t, s in zip(texts, _found(texts, shared.value), strict=True)], pa.string())
            i = part.schema.get_field_index("text")
            yield part.set_column(i, part.schema.field(i).with_type(pa.string()), new)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that `scan_pii` found: those by kind are of base spans; n_spans counts all, n_model the model's."""
    base = F.filter("spans", lambda s: s["base"] == 1)
    count = lambda no: F.size(F.filter("spans", lambda s: (s["base"] == 1) & (s["no"] == no))).cast("long")
    return found.select(
        "doc_id", *[count(no).alias(f"n_{kind}") for no, kind in enumerate(BASE_KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: s["base"] == 0)).cast("long").alias("n_model"),
    )
