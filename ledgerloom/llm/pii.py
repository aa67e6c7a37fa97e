"""Personal data: patterns propose, checksums confirm, context words adjust.

Every kind has a proposer (a regular expression, anchored so that it is linear in
the text), a validator where the kind has one (Luhn, mod-97, value ranges), a base
score, and words that move the score when they stand within NEAR characters: whole words,
in any case, of the languages of WORDS. The nearest one that speaks for the kind adds up to
RAISE, the nearest one that speaks against it (a sample, an order number) takes up to LOWER,
either one the less the farther off it stands. The four base kinds (email, ip, card, phone)
are kept whenever they validate, with their score. The further kinds are kept at `THRESHOLD`
and above: an iban validates by mod-97, a national number (3-2-4 digits) and a secret (a
long token of letters and digits) have no checksum and need a word nearby.

Defined results: a null text counts as empty and has no spans; texts are scanned
whole; offsets are code points, the end exclusive; rows repeat as they come; an empty
table gives no rows; extra columns pass through `redact` and are left out by `find`.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "national", "secret")
BASE = KINDS[:4]
#: Score from which a span of a further kind counts, and characters of context on either side.
THRESHOLD, NEAR = 0.6, 48
#: What the nearest word for a kind adds and the nearest against it takes, side by side with the span.
RAISE, LOWER = 0.4, 0.3
#: The letters of a local part, base scores, words for a kind (en, de, fr, es, pt) and against it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
SCORE = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.7, "national": 0.4, "secret": 0.4}
WORDS = {
    "email": "mail e-mail email contact write kontakt schreiben courriel contacter correo contacto escribir contato",
    "ip": "ip host server address adresse serveur servidor dirección endereço",
    "card": "card visa mastercard credit payment karte kreditkarte zahlung carte paiement tarjeta pago cartão pagamento",
    "phone": "phone call tel telephone mobile fax telefon anruf handy téléphone appeler portable teléfono llamar móvil telefone ligar",
    "iban": "iban bank account transfer konto überweisung banque compte virement banco cuenta transferencia conta",
    "national": "ssn social_security national_id insurance_number sozialversicherungsnummer versicherungsnummer ausweis sécurité_sociale numéro_national seguridad_social dni documento_nacional segurança_social identidade",
    "secret": "token secret password passwd pwd api_key apikey access_key private_key credential credentials passwort kennwort geheimnis schlüssel mot_de_passe jeton clé contraseña clave secreto senha segredo chave",
}
AGAINST = {
    "email": "example sample beispiel exemple ejemplo exemplo",
    "ip": "version release ausgabe versión versão",
    "card": "order invoice serial tracking bestellung rechnung commande facture pedido factura fatura",
    "phone": "order invoice serial bestellung rechnung commande facture pedido factura fatura",
    "iban": "example sample beispiel exemple ejemplo exemplo",
    "national": "order invoice serial part shipment bestellung rechnung lieferung commande facture pedido factura",
    "secret": "checksum commit sha1 sha256 md5 digest prüfsumme",
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: from the middle no match can begin that its start doesn't give.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}+")
_DIGIT = re.compile(r"[0-9]")


def _whole(words: str) -> re.Pattern:
    """Any of the words, whole; a low line between words stands for a blank, a dash, a low line or nothing."""
    each = "|".join(re.escape(w).replace("_", r"[\x20_-]?") for w in sorted(words.split(), key=len, reverse=True))
    return re.compile(rf"(?<![^\W_])(?:{each})(?![^\W_])", re.IGNORECASE)


_FOR, _NOT = ({k: _whole(w) for k, w in x.items()} for x in (WORDS, AGAINST))
_LONGEST = 32  # a word that begins nearby may end so many characters later


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    value = 0
    for c in s[4:] + s[:4]:
        value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return value == 1


def _emails(text: str):
    """Leftmost, non-overlapping: the local part is the run of its letters that ends at an @."""
    done, at = 0, text.find("@")
    previous = -1
    while at >= 0:
        if at >= done:
            head = text[max(done, previous + 1) : at]
            start = at - (len(head) - len(head.rstrip(LOCAL)))
            if start < at and (m := _DOMAIN.match(text, at)):
                yield start, m.end()
                done = m.end()
        previous = at
        at = text.find("@", at + 1)


def _outside(found: list[tuple[int, int, str]]):
    """A test whether (start, end) overlaps none of the spans found."""
    starts, ends = [], []
    for a, b, _ in sorted(found):
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)  # the largest end so far

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    return free


def _nearest(pattern: re.Pattern, text: str, start: int, end: int) -> float:
    """1 where such a word stands side by side with the span, half at NEAR characters, 0 beyond."""
    gap = None
    for m in pattern.finditer(text, max(0, start - NEAR - _LONGEST), start):
        if start - m.end() <= NEAR and not (m.end() == start and text[start].isalnum()):
            gap = start - m.end()  # the last one is the nearest
    m = pattern.search(text, end, min(len(text), end + NEAR + _LONGEST))
    if m and m.start() - end <= NEAR and (gap is None or m.start() - end < gap):
        gap = m.start() - end
    return 0.0 if gap is None else 1 - gap / (2 * NEAR)


def _context(text: str, kind: str, start: int, end: int) -> float:
    score = SCORE[kind] + RAISE * _nearest(_FOR[kind], text, start, end) - LOWER * _nearest(_NOT[kind], text, start, end)
    return round(min(1.0, max(0.0, score)), 3)


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all that counts, by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                    found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
        free = _outside(found)
        for m in _IBAN.finditer(text):
            a, b = m.span()
            while b - a >= 15 and not mod97(text[a:b]):  # a following word in capitals may have been taken in
                cut = text.rfind(" ", a, b)
                b = cut if cut > a else a
            if b - a >= 15:
                found.append((a, b, "iban"))
        found += [(*m.span(), "national") for m in _NATIONAL.finditer(text) if free(*m.span())]
        found += [(*m.span(), "secret") for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()]
    out = []
    for a, b, kind in found:
        score = _context(text, kind, a, b)
        if kind in BASE or score >= THRESHOLD:
            out.append((a, b, kind, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col and found, an array of (start, end, kind, score)."""
    small_batches(docs.sparkSession)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])

    def work(batches):
        for b in batches:
            rows = [[{"start": s, "end": e, "kind": k, "score": x} for s, e, k, x in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(work, f"id {kind}, found array<struct<start:bigint,end:bigint,kind:string,score:double>>").withColumnRenamed("id", id_col)


def _masked(text: str) -> str:
    out, done = [], 0
    for a, b, kind, _ in spans(text):
        if b <= done:
            continue
        a = max(a, done)
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each found span replaced by its kind in brackets. Where spans
    overlap, the rest of the later one is replaced too. Nulls stay null."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text)

    def work(batches):
        for b in batches:
            masked = pa.array([None if t is None else _masked(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else c for i, c in enumerate(b.columns)], names=names)

    return docs.mapInArrow(work, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest, text form and scores (in the order of the spans) of what `find` gives."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of_kind = lambda k: lambda x: x["kind"] == k
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select(
        id_col,
        *[F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, said)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", said)).alias("spans"),
        F.concat_ws(",", F.transform("found", lambda x: x["score"].cast("string"))).alias("scores"),
    )


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return digests(find(read(spark, sf_dir, "documents")))
