"""Problem 3: personal information in free text, found and replaced by typed placeholders.

A character-level bidirectional LSTM with CRF transitions, trained here in numpy from labelled spans, reads all text in
overlapping windows. Where windows of a text overlap, each gives way in the middle of the overlap, so every character has one
label and a text its labels as a whole. Items are the stretches the network labels; an exact check drops those that can't be what
they are labelled as (a phone number of three digits). No pattern proposes items. Training spans are drawn from published
formats (numbering plans, forms of identity numbers, postal conventions) and common names, set into sentences of the corpus.
Then the network trains itself further: where it finds an item in the corpus, the words around it are a frame for drawn items of
that type, so that what one form of a number taught it about a phrase holds for every form.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bare_id, has_text
from ..sources.tables import table
from .language import FREQUENT
from .models import fitted

TYPES = ("email", "phone", "id_number", "address", "person_name")
TAGS = 1 + len(TYPES)
HIDDEN = 24
#: Characters of a window, and by how much neighbours overlap.
WINDOW, OVERLAP = 256, 48
#: Windows run at once.
LANES = 512
#: Lengths of windows are rounded up to a multiple of this.
STEP = 32
#: Comments that lend sentences to the training set, chosen by a hash; training windows and their length; rounds over them.
FIT_COMMENTS, FIT_WINDOWS, FIT_LENGTH, EPOCHS = 8_000, 12_000, 112, 9
#: Rounds over windows of frames after that, by pass over the sample; most characters of a frame on each side of its item.
AGAIN, SIDE = (3, 4), 50
#: Least share of the places of a phrase at which the network finds the item, for the phrase to become a frame.
TRUST = 0.4
#: Characters between two stretches of one type that are one item.
GAP = 3


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


# --- from labels to items -------------------------------------------------------------------------------------------
_AT = re.compile(r"\w\s?(?:@|[\[({<]?\s?\bat\b\s?[\])}>]?)\s?\w.*?(?:\.|\bdot\b)\s?[\])}>]?\s?\w", re.I)
#: Titles of persons in seven languages.
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Señora?|Sr|Sra|Don|Doña|Monsieur|Madame|Mme|Mlle|Signora?|Sig|Senhora?|Dona|Meneer|Mevrouw|Dhr|Mevr)"
_PERSON = re.compile(rf"(?:{_TITLE}\.? )?[^\W\d_][\w'’-]*\.?(?: [^\W\d_][\w'’-]*\.?)+")
_INITIAL = re.compile(r"\s[A-ZÀ-Þ]\.? [A-ZÀ-Þ][\w'’-]+")
_PART, _DIGITS = re.compile(r"[ .\])}>]{1,2}[\[({<]?\s?\w+"), re.compile(r"[ .‑/-]\d+")
_TITLED = re.compile(rf"{_TITLE}\.? [^\W\d_]")


#: Words for streets in lower case, and words no name begins with.
_STREET = re.compile(r"\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|row|terrace|place|boulevard|blvd|way|square|crescent|hill|rue|calle|via|rua|piazza|plaza)\b|(?:straße|strasse|str|weg|allee|platz|gasse|straat|laan|plein|gracht|kade|dijk)\b", re.I)
_NO_NAME = frozenset("the a an this that these those my our your his her their i we you he she it der die das ein eine el los las un una le les des il lo gli o os as het een zum zur im am".split())


def _groups(item: str) -> list[tuple[int, ...]]:
    """Lengths of the groups of digits of a number, with and without what may be a country code."""
    groups = tuple(len(g) for g in re.findall(r"\d+", item))
    return [groups] + ([groups[1:]] if item.lstrip("(").startswith(("+", "00")) or (groups and groups[0] == 1) else [])


@functools.cache
def _plans() -> frozenset[tuple[int, ...]]:
    """Lengths of the groups of digits of the published forms of phone numbers."""
    return frozenset(g for f in _Maker.PHONES for g in _groups(f))


def possible(kind: str, item: str) -> bool:
    """Whether what stands there can be an item of its type at all."""
    n = _digits(item)
    if kind == "email":
        return bool(_AT.search(item))
    if kind == "phone":
        return sum(c.isalpha() for c in item) < 4 and any(x in _plans() for x in _groups(item))
    if kind == "id_number":
        return n >= 5 and 7 <= sum(c.isalnum() for c in item) <= 24
    if kind == "address":
        return n >= 1 and bool(_STREET.search(item) or re.search(r"(?:^|[^\w'’])[A-ZÀ-Þ][^\W\d_]{2}", item))
    words = item.split()
    if any(w.endswith(".") and len(w) > 2 and not re.fullmatch(_TITLE + r"\.", w) for w in words):
        return False  # a sentence ends there
    if words and words[0].lower() in _NO_NAME:
        return False
    return bool(_PERSON.fullmatch(item)) and 2 <= len(words) <= 6 and words[-1][:1].isupper() and (words[0][:1].isupper() or bool(_TITLED.match(item)))


def items_of(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Items of a text given the label of each character, in text order; they don't overlap.

    A stretch is made whole at word boundaries and loses blanks and signs at its ends; stretches of one type with little between
    them are one; of two kinds of label inside one run of digits the one with more characters counts.
    """
    change = np.flatnonzero(np.diff(tags)) + 1
    edges = [0, *change.tolist(), len(tags)]
    runs = [[a, b, int(tags[a]), b - a] for a, b in zip(edges, edges[1:]) if b > a and tags[a]]
    whole = []
    for run in runs:
        a, b = run[0], run[1]
        mail = TYPES[run[2] - 1] == "email"
        inside = (lambda c: not c.isspace() and c not in "<>()[]{},;:\"'") if mail else str.isalnum
        while a > 0 and inside(text[a - 1]) and inside(text[a]):
            a -= 1
        while b < len(text) and inside(text[b]) and inside(text[b - 1]):
            b += 1
        while a < b and not (text[a].isalnum() or (text[a] in "+(" and run[2] == 2)):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if run[2] == 5 and (more := _INITIAL.match(text, max(a, b - 2))):
            b = more.end()  # a name that stopped at an initial
        if b <= a:
            continue
        if whole:
            last = whole[-1]
            between = text[last[1] : a]
            same = last[2] == run[2] and (len(between) <= GAP or (mail and len(between) <= 6)) and not re.search(r"[.!?]\s+\S*[A-Z]" if run[2] == 5 else r"[!?\n]", between)
            numbers = {last[2], run[2]} <= {2, 3} and len(between) <= 2
            if a < last[1] or same or numbers:
                kind = last[2] if last[3] >= run[3] else run[2]
                whole[-1] = [last[0], max(last[1], b), kind, last[3] + run[3]]
                continue
        whole.append([a, b, run[2], run[3]])
    out = []
    for n, (a, b, k, _) in enumerate(whole):
        end = _completed(text, a, b, TYPES[k - 1], whole[n + 1][0] if n + 1 < len(whole) else len(text))
        if possible(TYPES[k - 1], text[a:end]):
            out.append((a, end, TYPES[k - 1]))
    return out


def _completed(text: str, a: int, b: int, kind: str, limit: int) -> int:
    """Where an item ends whose labels stopped before its last groups: at the first further group, of two, that makes it possible."""
    end = b
    for _ in range(2 if kind in ("email", "phone", "id_number") and not possible(kind, text[a:b]) else 0):
        more = (_PART if kind == "email" else _DIGITS).match(text, end, limit)
        if not more:
            break
        end = more.end()
        if possible(kind, text[a:end]):
            return end
    return b


# --- the network ----------------------------------------------------------------------------------------------------
def _symbols(text: str) -> np.ndarray:
    """A small number for each character: letters by case, digits, blanks and signs; other scripts share symbols."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _SYMBOL[np.minimum(c, 0x2FFF)]


def _table() -> np.ndarray:
    out = np.full(0x3000, 3, np.uint8)
    for i in range(32, 127):
        out[i] = 4 + i - 32
    for i in range(128, 0x3000):
        ch = chr(i)
        out[i] = 99 if ch.isalpha() and ch.isupper() else 100 if ch.isalpha() else 101 if ch.isdigit() else 36 if ch.isspace() else 102
    for i in (9, 10, 13):
        out[i] = 2
    for ch in "‐‑‒–—":
        out[ord(ch)] = 4 + ord("-") - 32
    return out


_SYMBOL = _table()
SYMBOLS = 104


def _slope(y: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * y - 1)) ** 2


class Tagger:
    """Parameters: for each direction input table, recurrent matrix; output matrix; CRF transitions and starts."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        make = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {}
        for d in ("f", "b"):
            self.p[d + "x"], self.p[d + "h"] = make(SYMBOLS, 4 * h), make(h, 4 * h)
            self.p[d + "x"][:, h : 2 * h] += 0.5  # forget less at first
        self.p["o"], self.p["ob"], self.p["t"] = make(2 * h, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)
        self.p["ob"][0] = 1.0
        self.p["t"] += 2 * np.eye(TAGS, dtype=np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states [T, B, H] over symbols [T, B], from front or back. Activations are x / (1 + |x|), gates half of that plus a half."""
        h = HIDDEN
        wx, wh = self.p[d + "x"], self.p[d + "h"]
        steps, lanes = x.shape
        out = np.empty((steps, lanes, h), np.float32)
        state, cell = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32)
        saved = []
        room, small = np.empty((lanes, 4 * h), np.float32), np.empty((lanes, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = wx[x[t]]
            g += np.matmul(state, wh, out=room)
            np.abs(g, out=room)
            room += 1
            g /= room
            s = g[:, : 3 * h]
            s *= 0.5
            s += 0.5
            i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            before, last = cell, state
            cell = f * cell
            cell += i * c
            np.abs(cell, out=small)
            small += 1
            th = cell / small
            state = np.multiply(o, th, out=out[t])
            if keep:
                saved.append((t, g, before, th, last))
        return (out, saved) if keep else out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = HIDDEN
        return self._run(x, "f") @ self.p["o"][:h] + self._run(x, "b") @ self.p["o"][h:] + self.p["ob"]

    def decode(self, x: np.ndarray, lean: float = 0.0) -> np.ndarray:
        """Viterbi labels [T, B]."""
        e, trans = self.emissions(x), self.p["t"]
        e[:, :, 0] -= lean
        steps, lanes, k = e.shape
        back = np.empty((steps, lanes, k), np.uint8)
        v = e[0]
        for t in range(1, steps):
            best = v[:, 0:1] + trans[0]
            arg = np.zeros((lanes, k), np.uint8)
            for j in range(1, k):
                other = v[:, j : j + 1] + trans[j]
                better = other > best
                np.copyto(best, other, where=better)
                arg[better] = j
            back[t] = arg
            v = best + e[t]
        out = np.empty((steps, lanes), np.uint8)
        out[-1] = v.argmax(axis=1)
        lane = np.arange(lanes)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, lane, out[t]]
        return out

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood per character of labels y under the CRF, and its gradient; masked steps count for nothing."""
        h, p = HIDDEN, self.p
        hf, sf = self._run(x, "f", True)
        hb, sb = self._run(x, "b", True)
        e = (hf @ p["o"][:h] + hb @ p["o"][h:] + p["ob"]) * mask[:, :, None]
        steps, lanes, k = e.shape
        trans = p["t"].astype(np.float64)
        et = np.exp(trans - trans.max())
        e64 = np.exp((e - e.max(axis=2, keepdims=True)).astype(np.float64))
        alpha, beta, norm = np.empty((steps, lanes, k)), np.ones((steps, lanes, k)), np.empty((steps, lanes))
        a = e64[0]
        for t in range(steps):
            a = e64[0] if t == 0 else (a @ et) * e64[t]
            norm[t] = a.sum(axis=1)
            a = a / norm[t][:, None]
            alpha[t] = a
        for t in range(steps - 2, -1, -1):
            beta[t] = (e64[t + 1] * beta[t + 1]) @ et.T / norm[t + 1][:, None]
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        onehot = np.eye(k)[y]
        both = mask[1:] * mask[:-1]
        left = alpha[:-1].reshape(-1, k)
        right = (e64[1:] * beta[1:] / norm[1:][:, :, None] * both[:, :, None]).reshape(-1, k)
        pair = (left.T @ right) * et
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), both.ravel())
        n = mask.sum()
        logz = (np.log(norm) + e.max(axis=2)).sum() + trans.max() * (steps - 1) * lanes
        gold = (e * onehot).sum() + (trans * seen).sum() + 0.0
        de = ((post - onehot) * mask[:, :, None] / n).astype(np.float32)
        grad = {"t": ((pair - seen) / n).astype(np.float32), "ob": de.sum(axis=(0, 1))}
        flat = de.reshape(-1, k)
        grad["o"] = np.concatenate([hf.reshape(-1, h).T @ flat, hb.reshape(-1, h).T @ flat])
        onehot_x = np.eye(SYMBOLS, dtype=np.float32)[x.ravel()]
        for d, saved, part in (("f", sf, p["o"][:h]), ("b", sb, p["o"][h:])):
            dh_all = de @ part.T
            every, gh = np.empty((steps, lanes, 4 * h), np.float32), np.zeros((h, 4 * h), np.float32)
            dh, dc = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32)
            for t, g, before, th, last in reversed(saved):
                i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - np.abs(th)) ** 2
                # the slope of a gate y is half of (1 - |2y - 1|) squared, that of the input (1 - |c|) squared
                dg = np.concatenate([dc * c * _slope(i), dc * before * _slope(f), dh * th * _slope(o), dc * i * (1 - np.abs(c)) ** 2], axis=1)
                every[t] = dg
                gh += last.T @ dg
                dh, dc = dg @ p[d + "h"].T, dc * f
            grad[d + "x"], grad[d + "h"] = onehot_x.T @ every.reshape(-1, 4 * h), gh
        return float(logz - gold) / n, grad


def train(texts: list[str], spans: list[list[tuple[int, int, str]]], *, epochs: int = EPOCHS, batch: int = 160, rate: float = 0.02, length: int = FIT_LENGTH, seed: int = 7, model: Tagger | None = None) -> Tagger:
    """Adam over windows of `length` characters of the texts, around their items where they have some; goes on from `model` if given."""
    rng = np.random.default_rng(seed)
    xs, ys, ms = [], [], []
    for t, items in zip(texts, spans):
        s, y = _symbols(t), np.zeros(len(t), np.uint8)
        for a, b, k in items:
            y[a:b] = 1 + TYPES.index(k)
        if len(s) > length:
            mid = items[rng.integers(len(items))][0] if items else rng.integers(len(s))
            lo = int(np.clip(mid - rng.integers(10, length - 10), 0, len(s) - length))
            s, y = s[lo : lo + length], y[lo : lo + length]
        pad = length - len(s)
        xs.append(np.pad(s, (0, pad)))
        ys.append(np.pad(y, (0, pad)))
        ms.append(np.pad(np.ones(len(s), np.float32), (0, pad)))
    x, y, m = np.stack(xs, 1), np.stack(ys, 1), np.stack(ms, 1)
    model = model or Tagger(seed)
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * -(-x.shape[1] // batch)
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            _, grad = model.loss(x[:, at], y[:, at], m[:, at])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            lr = rate * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / total))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.98 * m2[name] + 0.02 * g * g
                model.p[name] = model.p[name] - lr * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.98**step)) + 1e-7)
                model.p[name] = model.p[name].astype(np.float32)
    return model


# --- labelled spans -------------------------------------------------------------------------------------------------
#: Common given names of many countries, common surnames, and syllables and ends of which rarer ones are made.
_GIVEN = """Adam Adrian Agnes Ahmed Aisha Alan Albert Alejandra Alex Alice Amir Ana Andrea Andrew Angela Anna Antonio Arthur Astrid Beatriz Ben Bernard Björn Bram Brian Bruno
Camille Carla Carlos Caroline Catherine Chen Chiara Chloé Christian Clara Claudia Daan Daniel David Diego Dieter Dmitri Eduardo Elena Elif Elisa Elizabeth Emma Eric Erik Eva Fatima Felix Fernando
Francesca François Frank Friedrich Gabriel George Giulia Giovanni Grace Greta Guillermo Hannah Hans Harry Hassan Heather Helen Henrik Hugo Ibrahim Ines Ingrid Irene Isabel Ivan Jack Jacob James Jan
Jasper Javier Jean Joana João John Jonas Jorge José Juan Julia Karen Karin Kevin Klaus Kofi Lars Laura Lena Leon Liam Linda Lisa Lotte Louis Luca Lucia Luis Maria Marie Mark Marta Martin Mary Mateo
Matthew Mehmet Mei Michael Miguel Mohammed Monika Nadia Natalia Nicolas Nina Noah Nora Olga Oliver Omar Oscar Pablo Paolo Patricia Paul Pedro Peter Petra Philip Pierre Priya Rachel Raj Ravi Robert Roberto
Rosa Ruth Samuel Sandra Sanne Sara Simon Sofia Sophie Stefan Susan Sven Tanja Thomas Tiago Tomas Ursula Victor Vincent Walter Wei Will William Yuki Yusuf Zoe""".split()
_SURNAMES = """Smith Jones Brown Taylor Wilson Johnson Miller Davis Clark Wright Müller Schmidt Schneider Fischer Weber Becker Hoffmann García López Martínez Fernández Sánchez Pérez Martin Bernard Dubois
Durand Lefebvre Moreau Rossi Russo Ferrari Bianchi Romano Silva Santos Ferreira Pereira Oliveira Jansen Visser Bakker Smit Meijer Nguyen Kim Lee Patel Khan Kowalski Novak Ivanov Larsen""".split()
_ONSET, _VOWEL, _CODA = "b br c ch d dr f fl g gr h j k kl l m n p pl qu r s sh st t tr v w y z".split(), "a e i o u a e o ai ei ou".split(), "l n r s t m ck nd rt x st ll nn rk ng mb sh".split()
_ENDS = "er ic son sen ini ez ov ova ski mann berg ard elli eau ier ano well ton ford field by wood dorf stein ak uk as es ick ett low".split()
_PLACE_ENDS = "ton ham ford burg dorf stad ville heim mont port field mouth bach haven wick ley dam mund".split()
#: Fixed values, by language: words that lead up to an item of a type, and to a number that is nobody's ("no").
_LEAD = {
    "en": {
        "person_name": "I spoke to|my neighbour|our manager|written by|a man called|my name is|signed|her cousin|ask for|the owner,|thank you|greetings from|Dear|our doctor|met|says|the tenant|hired|I know",
        "email": "mail|e-mail|email:|write to|reach me at|send the files to|forward it to|contact|my address is|address:|account|drop a line to|reply to",
        "phone": "phone|call|call me at|my number|tel.|Tel:|mobile|cell|text|ring|dial|fax|his number is|number:|WhatsApp|reach us on|contact number|landline|phoned from",
        "id_number": "SSN|social security|social security number|passport|passport number|passport no.|tax number|tax id|driver's licence|driving licence no.|licence number|national id|id card|identity card|identity number|national insurance|insurance number|ID:",
        "address": "lives at|home is|address:|ship to|send to|moved to|deliver it to|house at|office at|flat at|come to|parcel for|meet at|from",
        "thing": "the|The|the|The|our|at the|near the|in|about|read|watched|visited|a|this|called the",
        "no": "order|ticket|invoice|part|serial|model|version|code|page|room|tracking|price|score|release|build|case|article|item|chapter|catalogue|reference|booking|flight|bug|about|roughly|population|in|from|until|on|it cost|paid|there were|at|worth|scored|counted",
    },
    "de": {
        "person_name": "mein Nachbar|ich heiße|unterschrieben von|die Ärztin|frag|laut|mit|von|der Chef,|Grüße von",
        "email": "E-Mail:|schreib an|Mail an|meine Adresse|erreichbar unter|Kontakt:",
        "phone": "Telefon|Tel.|Handy|Handynummer|ruf an unter|anrufen:|meine Nummer|Festnetz|erreichbar unter",
        "id_number": "Ausweis|Ausweisnummer|Personalausweis|Reisepass|Steuer-ID|Steuernummer|Führerschein|Sozialversicherungsnummer|Passnummer",
        "address": "wohnt in der|Adresse:|schick es in die|Anschrift|Büro in der|Haus in der|Lieferung an",
        "no": "Bestellung|Bestellnummer|Rechnung|Artikel|Ticket|Version|Seite|Seriennummer|Preis|Modell|Sendung|Raum|Kapitel",
    },
    "es": {
        "person_name": "mi vecino|se llama|firmado por|pregunta por|según|con|la doctora|saludos de",
        "email": "correo:|escribe a|mi correo es|envía a|contacto:",
        "phone": "teléfono|tel.|móvil|llama al|mi número es|llámame al|fijo|número de teléfono",
        "id_number": "DNI|NIE|pasaporte|número de pasaporte|número fiscal|carnet de conducir|documento de identidad|seguridad social",
        "address": "vive en|dirección:|enviar a|oficina en|la casa de|domicilio",
        "no": "pedido|factura|artículo|versión|página|billete|precio|modelo|código|sala|capítulo|envío",
    },
    "fr": {
        "person_name": "mon voisin|je m'appelle|signé|demandez|selon|avec|le docteur,|salutations de",
        "email": "courriel :|écris à|mon adresse|envoyez à|contact :",
        "phone": "téléphone|tél.|portable|appelle le|mon numéro est le|numéro :|joignable au|fixe",
        "id_number": "carte d'identité|passeport|numéro de passeport|numéro fiscal|permis de conduire|sécurité sociale|numéro de sécurité sociale",
        "address": "habite au|adresse :|envoyer au|bureau au|la maison du|livrer au",
        "no": "commande|facture|article|version|page|billet|prix|modèle|code|salle|chapitre|colis",
    },
    "it": {
        "person_name": "il mio vicino|mi chiamo|firmato|chiedi di|secondo|con|la dottoressa|saluti da",
        "email": "posta:|scrivi a|la mia mail è|manda a|contatto:",
        "phone": "telefono|tel.|cellulare|chiama il|il mio numero è|numero:|fisso|chiamami al",
        "id_number": "codice fiscale|carta d'identità|passaporto|numero di passaporto|patente|tessera sanitaria|documento",
        "address": "abita in|indirizzo:|spedisci in|ufficio in|la casa di|consegna in",
        "no": "ordine|fattura|articolo|versione|pagina|biglietto|prezzo|modello|codice prodotto|sala|capitolo|pacco",
    },
    "pt": {
        "person_name": "o meu vizinho|chamo-me|assinado por|pergunta por|segundo|com|a doutora|cumprimentos de",
        "email": "correio:|escreve para|o meu e-mail é|envia para|contacto:",
        "phone": "telefone|tel.|telemóvel|liga para o|o meu número é o|número:|fixo|ligar",
        "id_number": "cartão de cidadão|NIF|número fiscal|passaporte|número do passaporte|carta de condução|bilhete de identidade|contribuinte",
        "address": "mora na|morada:|enviar para a|escritório na|a casa da|entregar na",
        "no": "encomenda|fatura|artigo|versão|página|bilhete|preço|modelo|código do produto|sala|capítulo|pacote",
    },
    "nl": {
        "person_name": "mijn buurman|ik heet|getekend door|vraag naar|volgens|met|de dokter,|groeten van",
        "email": "mail naar|schrijf naar|mijn adres is|stuur naar|contact:",
        "phone": "telefoon|tel.|mobiel|bel|mijn nummer is|nummer:|bereikbaar op|vast nummer",
        "id_number": "burgerservicenummer|BSN|paspoort|paspoortnummer|rijbewijs|identiteitskaart|fiscaal nummer|sofinummer",
        "address": "woont op de|adres:|stuur naar|kantoor op de|het huis aan de|bezorgen op",
        "no": "bestelling|factuur|artikel|versie|pagina|kaartje|prijs|model|productcode|zaal|hoofdstuk|pakket",
    },
}
#: What may stand before a made name that is no person's.
_THING = "Lake Mount River Hotel Café Port Saint Planet Project Team Studio Radio Club Super Mega Hyper New North Old Grand Royal Royal Fort Castle Cape Camp".split()
_AFTER = "Museum Prize Valley Station Hotel Bridge Airport Festival Cup Park Theatre Institute Harbour Records Games Motors Pro Max Plus Prime Series Deluxe Edition University Library Market Tower Race Line Street Road Avenue Square Lane".split()


class _Maker:
    """Draws items of each type: (text with the item, where it begins, where it ends)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def of(self, options):
        return options[self.r.integers(len(options))]

    def d(self, n: int) -> str:
        return "".join(str(x) for x in self.r.integers(0, 10, n))

    def letters(self, n: int) -> str:
        return "".join(self.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def form(self, pattern: str) -> str:
        """9: a digit, 8: one of 1 to 9, A: a capital; the rest as it stands. Some numbers have long runs of zeros."""
        zeros = self.r.random() < 0.25
        out = "".join(("0" if zeros and self.r.random() < 0.6 else self.d(1)) if c == "9" else str(self.r.integers(1, 10)) if c == "8" else self.letters(1) if c == "A" else c for c in pattern)
        return out.replace("-", "‑") if self.r.random() < 0.05 else out

    def stem(self, lo: int = 1, hi: int = 3) -> str:
        return "".join(self.of(_ONSET) + self.of(_VOWEL) + (self.of(_CODA) if self.r.random() < 0.6 else "") for _ in range(self.r.integers(lo, hi + 1)))

    def place(self) -> str:
        return (self.stem(1, 2) + (self.of(_PLACE_ENDS) if self.r.random() < 0.5 else "")).capitalize()

    def surname(self) -> str:
        k = self.r.random()
        s = self.of(_SURNAMES) if k < 0.2 else (self.stem(1, 2) + (self.of(_ENDS) if k < 0.85 else "")).capitalize()
        if self.r.random() < 0.06:
            s = self.of(("van", "von", "de", "da", "di", "del", "van der", "de la")) + " " + s
        return s + "-" + (self.stem(1, 2) + self.of(_ENDS)).capitalize() if self.r.random() < 0.12 else s

    def person_name(self) -> str:
        if self.r.random() < 0.18:
            return self.of(("Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Herr", "Frau", "Señor", "Señora", "Sr.", "Monsieur", "Madame", "Mme", "Signor", "Signora", "Senhor", "Senhora", "Meneer", "Mevrouw", "Prof.")) + " " + self.surname()
        given = self.of(_GIVEN) if self.r.random() < 0.92 else self.stem(1, 2).capitalize()
        return given + (f" {self.letters(1)}." if self.r.random() < 0.12 else "") + " " + self.surname()

    def email(self) -> str:
        first, last = self.of(_GIVEN).lower(), (self.stem(1, 2) + self.of(_ENDS)).lower()
        local = self.of((first + self.of((".", "-", "_", "")) + last, first[0] + last, last, first, last + "_" + self.d(self.r.integers(1, 4)), first + "+" + self.stem(1, 2), first + "." + last + self.d(self.r.integers(1, 3)), last + self.d(self.r.integers(1, 4))))
        host = [self.of(("example", "mail", "post", "inbox", "lists", "web", self.stem(1, 2), self.stem(1, 3), self.stem(2, 3)))]
        if self.r.random() < 0.2:
            host.append(self.of(("example", "mail", self.stem(1, 2))))
        host.append(self.of(("com", "org", "net", "de", "fr", "es", "it", "nl", "pt", "uk", "eu", "info", "test", "example", "invalid")))
        k = self.r.random()
        at, dot = ("@", ".") if k < 0.55 else self.of(((" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" @ ", "."), ("@ ", "."), (" at ", "."), ("{at}", "."), ("<at>", "."), (" [at] ", "."), ("[at]", ".")))
        mail = local + at + dot.join(host)
        return mail.upper() if self.r.random() < 0.1 else mail

    #: How national and international numbers are written (North America, UK, DE, FR, ES, IT, PT, NL).
    PHONES = (
        "899-999-9999|(899) 999-9999|899.999.9999|899 999 9999|+1 899 999 9999|+1-899-999-9999|1-899-999-9999|+1 (899) 999-9999|+1899 9999999|18999999999|899 999 99 99|+1 899.999.9999|8999999999|(899)999-9999|"
        "020 7999 9999|07999 999999|+44 7999 999999|+44 20 7999 9999|0161 999 9999|07999 999 999|01632 999999|(020) 7999 9999|"
        "030 9999999|030 99999 999|0899 9999999|+49 30 9999999|+49 30 99999999|+49 179 9999999|0179 9999999|0179/9999999|(0899) 999999|0899/999999|+49 (0)899 999999|0899-9999999|"
        "06 99 99 99 99|01 99 99 99 99|01.99.99.99.99|06.99.99.99.99|+33 6 99 99 99 99|+33 1 99 99 99 99|0699999999|"
        "699 999 999|699 99 99 99|+34 699 999 999|919 99 99 99|+34 919 99 99 99|699999999|"
        "399 9999999|399 999 9999|+39 399 999 9999|06 9999999|+39 06 99999999|399 999999|02 99999999|"
        "919 999 999|+351 919 999 999|219 999 999|+351 219 999 999|969999999|"
        "06-99999999|06 99999999|06-9999 9999|+31 6 99999999|+31 6 9999 9999|020-9999999|020 999 9999|+31 20 999 9999"
    ).split("|")
    #: How numbers of persons are written (social security, tax, insurance, passport, licence and card numbers of the same countries).
    IDS = (
        "999-99-9999|999 99 9999|999-99-9999|999 99 9999|99-9999999|A99999999|AA999999A|AA 99 99 99 A|AA 99 99 99 A|AA999999A|999999999|A9999999|AAAAA999999AA9AA|"
        "99 999 999 999|99999999999|99/999/99999|999/999/99999|A99AA99A99|A99999999|AA9999999|99 999999 A 999|"
        "8 99 99 99 999 999 99|8 99 99 99 999 999|899999999999999|999999999999|99AA99999|"
        "99999999-A|99999999A|A-9999999-A|A9999999A|AAA999999|"
        "AAAAAA99A99A999A|AA99999AA|AA9999999|AA9999999A|"
        "999999999|999 999 999|99999999 9 AA9|999999999AA9|A999999|"
        "999999999|9999.99.999|9999 99 999|AAAA99999|A99999999"
    ).split("|")
    #: What numbers that are nobody's look like.
    OTHERS = "9|99|999|9999|99,999|9,999,999|99.99|9.99.999|9.9.9|999.9999.99|20-99-99|2099-09-19|19/19/2099|99:99|99-99|999-9999-99|99-999-9999|99999|999999|99999999|999999999|AA-9999|A9999|9999/99|aaaa9999|999-99|#99999|999,9999|9.999,99|999,999.99|999.999|99%|$999|999 999|99-999|999999-99|AAA-99999-A".split("|")

    def phone(self) -> str:
        return self.form(self.of(self.PHONES))

    def id_number(self) -> str:
        return self.form(self.of(self.IDS))

    def no(self) -> str:
        """A number that is nobody's; often it looks as one of a person might, and only the words before it tell."""
        if self.r.random() < 0.4:
            return self.form(self.of([f for f in self.IDS + self.PHONES if not re.search(r"[A+(./]|^0", f)]))
        return self.form(self.of(self.OTHERS)).replace("aaaa", self.stem(2, 2))

    def address(self, lang: str) -> str:
        """House, street, and perhaps flat, code and town, as each country writes them."""
        n = str(self.r.integers(1, 300)) + (self.of(("", "A", "B", "C", "a", "b")) if self.r.random() < 0.3 else "")
        s, t = self.place(), self.place()
        s = f"{s} {self.place()}" if self.r.random() < 0.08 else s
        if lang == "en":
            kind = self.of("Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Close Row Terrace Place Boulevard Blvd Way Square Crescent Hill".split())
            if self.r.random() < 0.25:
                s, kind = s.lower(), kind.lower()
            if self.r.random() < 0.12:
                s = self.of(("North", "South", "East", "West", "north", "south", "east", "west", "N", "S")) + " " + s
            flat = self.of(("", "", "", f"Flat {self.d(1)}, ", f"Apt {self.d(2)}, ", f"Unit {self.d(1)}, "))
            tail = self.of(("", "", f" apt {self.d(1)}", f", Apt. {self.d(2)}", f" flat {self.d(1)}")) if not flat else ""
            code = self.of(("", "", " " + self.d(5), f" {self.letters(2)}{self.d(1)} {self.d(1)}{self.letters(2)}", f" {self.letters(1)}{self.d(2)} {self.d(1)}{self.letters(2)}"))
            town = self.of(("", f", {t}{code}", f", {t}{code}", f", {t}{code}", f" in {t}", f" {t}", f", {t}, {self.letters(2)}{code}"))
            return f"{flat}{n} {s} {kind}{tail}{town}"
        code = self.d(5) if lang != "nl" else self.d(4) + self.of(("", " ")) + self.letters(2)
        code = self.d(4) + "-" + self.d(3) if lang == "pt" else code
        place = self.of(("", f", {code} {t}", f", {code} {t}", f", {t}", f" {code} {t}", f" in {t}" if lang in ("de", "nl", "it") else f" en {t}" if lang == "es" else f" à {t}" if lang == "fr" else f" em {t}"))
        if lang == "de":
            return f"{s}{self.of(('straße', 'strasse', 'str.', 'weg', 'allee', 'platz', 'gasse', ' Straße', '-Straße', 'ring', 'ufer'))} {n}{place}"
        if lang == "nl":
            return f"{s}{self.of(('straat', 'laan', 'weg', 'plein', 'gracht', 'kade', 'dijk', 'singel'))} {n}{place}"
        if lang == "fr":
            return f"{n}{self.of(('', ',', ' bis'))} {self.of(('rue', 'avenue', 'boulevard', 'place', 'allée', 'chemin', 'impasse', 'quai'))} {self.of(('', 'de ', 'du ', 'des ', 'de la '))}{s}{place}"
        kinds = {"es": ("Calle", "calle", "Avenida", "Plaza", "Paseo", "C/"), "it": ("Via", "via", "Piazza", "Viale", "Corso", "Vicolo"), "pt": ("Rua", "rua", "Avenida", "Travessa", "Praça", "Largo")}[lang]
        return f"{self.of(kinds)} {self.of(('', '', 'de ', 'del ' if lang != 'pt' else 'do ', 'della ' if lang == 'it' else 'da '))}{s}{self.of((' ', ', '))}{n}{place}"

    def thing(self, carriers: list[str]) -> str:
        """Capitalised words that name no person; those of titles are words of the carriers."""
        k, a, b = self.r.random(), self.place(), self.of(_AFTER)
        word = lambda: self.of([w for w in self.of(carriers).split() if w.isalpha()] or ["Rain"]).capitalize()
        if k < 0.2:
            return f"{self.of(_THING)} {a}"
        if k < 0.45:
            return f"{a} {b}"
        if k < 0.6:
            return f"{a} {b} {self.d(self.r.integers(1, 5))}"
        if k < 0.7:
            return f"{self.of(_THING)} {a} {b}"
        if k < 0.8:
            return " ".join([word() for _ in range(self.r.integers(1, 3))] + [self.of(("over", "of", "under", "in", "without", "and", "from")).capitalize(), self.of((a, word()))])
        if k < 0.9:
            return self.of(_GIVEN) + self.of(("", " and " + self.of(_GIVEN), ",", "'s"))
        return self.of(("u/", "@", "r/", "#")) + self.stem(1, 3)


def made_up(count: int, carriers: list[str], seed: int = 9) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Labelled texts: items, or things that only look like one, with words that lead up to them, between and within carriers."""
    m = _Maker(seed)
    carriers = carriers or ["Some rain fell before lunch."]
    langs = list(_LEAD)
    texts, spans = [], []
    for k in range(count):
        text, items = "", []
        for _ in range(m.r.integers(1, 3)):
            c, where = m.of(carriers).split(" "), m.r.random()
            at = 0 if where < 0.3 else len(c) if where < 0.65 else int(m.r.integers(0, len(c) + 1))
            c = c[max(0, at - 8) : at + 8]
            at = min(at, 8, len(c))
            text += " ".join(c[:at]) + (" " if at else "")
            lang = "en" if m.r.random() < 0.5 else m.of(langs)
            kind = m.of(TYPES) if m.r.random() < 0.72 else m.of(("no", "no", "thing"))
            often = {"no": 1.0, "phone": 0.9, "id_number": 0.9}.get(kind, 0.65)
            lead = m.of(_LEAD[lang][kind].split("|")) if kind in _LEAD[lang] and m.r.random() < often else ""
            if kind == "no" and lang == "en" and lead and m.r.random() < 0.4:
                lead += m.of((" number", " no.", " code", " #", " id", " nr"))
            if lead and (at == 0 or m.r.random() < 0.3):
                lead = lead[0].upper() + lead[1:]
            if lead:
                text += lead + m.of((" ", " ", " ", ": ", " is ", " no. ", " (")) if lead[-1].isalnum() else lead + " "
            item = m.address(lang) if kind == "address" else m.thing(carriers) if kind == "thing" else getattr(m, kind)()
            if kind in TYPES:
                items.append((len(text), len(text) + len(item), kind))
            text += item + m.of((" ", " ", " ", ". ", ". ", "! ", ", ", " , ", ") ", "? ", " - ", "; "))
            text += " ".join(c[at:]) + m.of((" ", " ", ". "))
        if m.r.random() < 0.04 and len(text.upper()) == len(text):
            text = text.upper()
        texts.append(text)
        spans.append(items)
    return texts, spans


def _language(text: str) -> str:
    """The language whose frequent words are most frequent in the text."""
    words = text.lower().split()
    return max(_LEAD, key=lambda k: sum(w in _OFTEN[k] for w in words))


_OFTEN = {k: frozenset(FREQUENT[k].split()) for k in _LEAD}


def frames(model: Tagger, texts: list[str]) -> list[tuple[str, str, str, str]]:
    """(type, text before, text after, language) of the phrases in which the model finds items, each phrase once.

    A phrase reaches to the ends of its sentence, but no further than SIDE characters, and has no sign of another item in it. Of a
    phrase found with several types the most frequent counts; one that the texts have far more often than with an item is left out.
    """
    found: dict[tuple[str, str], Counter] = {}
    kept: dict[tuple[str, str, str], tuple[str, str, str]] = {}
    for t, tags in zip(texts, labels(model, texts)):
        items = items_of(t, tags) if tags.any() else []
        for n, (a, b, kind) in enumerate(items):
            lo = max(items[n - 1][1] if n else 0, a - SIDE)
            hi = min(items[n + 1][0] if n + 1 < len(items) else len(t), b + SIDE)
            before, after = re.split(r"(?<=[.!?])\s+", t[lo:a])[-1], re.split(r"(?<=[.!?])\s", t[b:hi])[0]
            if "@" in before + after or _digits(before + after) > 4:
                continue
            key = (" ".join(before.lower().split()[-3:]), " ".join(after.lower().split()[:2]).strip(" .,!?"))
            found.setdefault(key, Counter())[kind] += 1
            kept.setdefault((kind, *key), (before, after, _language(t[max(0, a - 300) : b + 300])))
    best = {k: min(c, key=lambda x: (-c[x], x)) for k, c in found.items()}
    hits: Counter = Counter()
    for (before, _), c in found.items():
        hits.update({(kind, before): n for kind, n in c.items()})
    whole = " \n".join(" ".join(t.split()) for t in texts)
    low = whole.translate({ord(c): c.lower() for c in set(whole) if len(c.lower()) == 1})
    share: dict[tuple[str, str], float] = {}
    for kind, before in hits:
        at, places = low.find(before + " ") if before else -1, 0
        while at >= 0:
            places += _begins(kind, whole[at + len(before) + 1 : at + len(before) + 2])
            at = low.find(before + " ", at + 1)
        share[kind, before] = hits[kind, before] / max(1, places) if before else 1.0
    trusted = [k for k in sorted(found) if share[best[k], k[0]] >= TRUST and (k[0] or k[1])]
    often = [k for k in trusted if found[k][best[k]] > 1]
    return [(best[k], *kept[best[k], *k]) for k in often or trusted]


def _begins(kind: str, c: str) -> bool:
    """Whether an item of this type could begin with c."""
    return c.isupper() if kind == "person_name" else c.isalnum() if kind in ("email", "address") else c.isdigit() or c in "+(" or (kind == "id_number" and c.isupper())


def framed(count: int, known: list[tuple[str, str, str, str]], carriers: list[str], seed: int) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Labelled texts: drawn items in frames, as many of each type, between sentences of the corpus."""
    m = _Maker(seed)
    by = {k: [f for f in known if f[0] == k] for k in TYPES}
    kinds = [k for k in TYPES if by[k]]
    texts, spans = [], []
    for _ in range(count if kinds else 0):
        kind = m.of(kinds)
        _, before, after, lang = m.of(by[kind])
        head = " ".join(m.of(carriers).split()[-6:]) + " " if carriers and m.r.random() < 0.7 else ""
        if before and m.r.random() < 0.2:
            before = before[0].swapcase() + before[1:]
        item = m.address(lang) if kind == "address" else getattr(m, kind)()
        tail = " " + " ".join(m.of(carriers).split()[:6]) if carriers and m.r.random() < 0.7 else ""
        texts.append(head + before + item + after + tail)
        spans.append([(len(head + before), len(head + before + item), kind)])
    return texts, spans


def _plain(sentence: str, starts: frozenset[str] = frozenset()) -> bool:
    """True if a sentence of the corpus surely holds no item: no mail sign, few digits and none beside a capital, no two capitals in a row,
    but for a first word that many sentences begin with."""
    if "@" in sentence or _digits(sentence) > 4 or re.search(r"[\[({<]\s?(?:at|dot)\s?[\])}>]| dot ", sentence, re.I):
        return False
    capitals = [w[:1].isupper() for w in sentence.split()]
    if any(a and b for a, b in zip(capitals[1:], capitals[2:])) or (sum(capitals) > 1 and _digits(sentence)):
        return False
    return not (len(capitals) > 1 and capitals[0] and capitals[1] and sentence.split()[0] not in starts)


def fit(comments: DataFrame, *, sample: int = FIT_COMMENTS, windows: int = FIT_WINDOWS) -> Tagger:
    """Trains on drawn items in sentences of a bounded sample of comments, chosen by hash, and on sentences without any."""
    usable = comments.where(has_text("body_clean"))
    n = max(1, usable.count())
    rows = usable.where(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / n)).select("body_clean").collect()
    return learn(sorted(r.body_clean for r in rows), windows)


def learn(texts: list[str], windows: int = FIT_WINDOWS) -> Tagger:
    if not texts:
        return Tagger()  # nothing to read
    said = [s for t in texts for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]
    first = Counter(s.split()[0] for s in said)
    starts = frozenset(w for w, n in first.items() if n * 500 >= len(said))
    plain = [s for s in said if _plain(s, starts)]
    made, spans = made_up(windows * 4 // 5, plain)
    free = [" ".join(plain[k : k + 2]) for k in range(0, min(len(plain), windows * 2 // 5) - 1, 2)]
    model = train(made + free, spans + [[] for _ in free])
    for k, epochs in enumerate(AGAIN):
        known = frames(model, texts)
        if not known:
            break
        more, where = framed(windows * 2 // 5, known, plain, 31 + k)
        drawn, spots = made_up(windows * 2 // 5, plain, 51 + k)
        model = train(more + drawn + free, where + spots + [[] for _ in free], epochs=epochs, rate=0.01, seed=17 + k, model=model)
    return model


def labels(model: Tagger, texts: list[str]) -> list[np.ndarray]:
    """The label of each character of each text, from overlapping windows that begin at fixed places of the text.

    So a text has the same labels whatever it is read with. Windows of about one length are run together.
    """
    stride, half = WINDOW - OVERLAP, OVERLAP // 2
    out = [np.zeros(len(t), np.uint8) for t in texts]
    lanes: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, t in enumerate(texts):
        s = _symbols(t)
        for at in range(0, max(1, len(s) - OVERLAP), stride):
            w = s[at : at + WINDOW]
            lanes.setdefault(-(-len(w) // STEP) * STEP, []).append((i, at, w))
    for length, todo in lanes.items():
        for k in range(0, len(todo) if length else 0, LANES):
            part = todo[k : k + LANES]
            x = np.zeros((length, len(part)), np.uint8)
            for j, (_, _, w) in enumerate(part):
                x[: len(w), j] = w
            tags = model.decode(x)
            for j, (i, at, w) in enumerate(part):
                # neighbours meet in the middle of their overlap
                lo = half if at else 0
                hi = len(w) if at + len(w) == len(texts[i]) else stride + half
                out[i][at + lo : at + hi] = tags[lo:hi, j]
    return out


def find(df: DataFrame, key: list[str], text: str, model: Tagger) -> DataFrame:
    """key, masked (the text with placeholders such as [EMAIL]), items (type, occurrence, start, end), for texts with an item or none.

    Null, blank and removed texts come back unchanged with no items.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for pdf in batches:
            for k in range(0, len(pdf), 10_000):
                part = pdf.iloc[k : k + 10_000]
                texts = list(part["__t"])
                real = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip() and t.strip() not in ("[removed]", "[deleted]")]
                masked, items = list(texts), [[] for _ in texts]
                for i, tags in zip(real, labels(m, [texts[i] for i in real])):
                    if not tags.any():
                        continue
                    t, seen, new, at = texts[i], dict.fromkeys(TYPES, 0), [], 0
                    for a, b, kind in items_of(t, tags):
                        seen[kind] += 1
                        items[i].append({"pii_type": kind, "occurrence": seen[kind], "start": a, "end": b})
                        new += [t[at:a], f"[{kind.upper()}]"]
                        at = b
                    masked[i] = "".join([*new, t[at:]])
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in key}, "masked": masked, "items": items})

    rows = df.select(*key, F.col(text).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__t")
    return rows.mapInPandas(run, schema + ", masked string, items array<struct<pii_type:string,occurrence:int,start:int,end:int>>")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    comments = table(spark, folder, "comments")
    model = fitted(spark, "pii", [comments], lambda: fit(comments))
    return find(comments.select(bare_id("id").alias("comment_id"), "body_clean").where("comment_id is not null"), ["comment_id"], "body_clean", model)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select("comment_id", F.explode("items").alias("i"))
    return rows.select("comment_id", "i.pii_type", "i.occurrence").distinct()


def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Each comment with its items replaced; comments without any are left as they are, and so are removed and null texts.

    Of the rows of one comment one with a text stands for it, where there is one.
    """
    best = F.max(F.struct(has_text("masked").alias("real"), "masked", F.size("items").alias("items")))
    return _rows(spark, folder).groupBy("comment_id").agg(best.alias("b")).select("comment_id", F.col("b.masked").alias("body_masked"), "b.items")


QUERIES = {"p3_found": p3_found, "p3_masked": p3_masked}
ORACLE: dict[str, str] = {}
