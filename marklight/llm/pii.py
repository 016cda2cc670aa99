"""Personal information inside free text: patterns propose, validators confirm, context words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklight.session import cut, table

# Patterns and words.
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
DOT = r"(?:\.|\s*\(dot\)\s*|\s*\[dot\]\s*|\s*\{dot\}\s*|\s+dot\s+|\s+punkt\s+|\s+punto\s+|\s+point\s+)"
AT = r"(?:\s?@\s?|&#64;|&commat;|\s*[(\[{<]\s*(?:at|ät|a|arroba|arobase|@)\s*[)\]}>]\s*)"
SAID_AT = r"\s+(?:at|arroba|arobase|ät)\s+"
LOCAL = r"(?<![\w.+%-])[A-Za-z0-9_][A-Za-z0-9._%+-]*"
EMAIL = re.compile(rf"{LOCAL}{AT}{LABEL}(?:{DOT}{LABEL})*{DOT}[A-Za-z]{{2,}}(?![\w@-])", re.I)
#: With a bare "at" the dots must be spelt too, else any two words around "at" would do.
SAID_EMAIL = re.compile(rf"{LOCAL}{SAID_AT}{LABEL}(?:\s*[(\[{{]?\b(?:dot|punkt|punto|point)\b[)\]}}]?\s*{LABEL})+(?![\w@-])", re.I)
AT_SIGN = re.compile(r"@|&#64;|&commat;|[(\[{<]\s*(?:at|ät|a|arroba|arobase)\s*[)\]}>]", re.I)
SAID_DOT = re.compile(r"\b(?:dot|punkt|punto|point)\b", re.I)
PLAIN_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+@{LABEL}(?:\.{LABEL})+")
PHONE = re.compile(
    r"(?<![\w./#@:+-])(?:"
    r"(?:\+|00)\d{1,3}[ .\-/]?(?:\(\d{1,5}\)[ .\-/]?)?\d{1,8}(?:[ .\-/]\d{1,8}){0,5}"
    r"|\(\d{2,5}\) ?\d{3,4}[ .\-/]?\d{3,5}"
    r"|0\d{1,4}[ /\-.]\d{3,9}(?:[ \-.]\d{2,5}){0,3}"
    r"|[2-9]\d{2}([ .\-])\d{3}\1\d{4}"
    r")(?![\w@-]|[./]\d)"
)
TOWN = r"(?:[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?)"
SUFFIX = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Row|Close|Crescent|Cres|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Gardens|Grove|Hill|Walk|Alley|Mews|Parade)"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Wohnung|Piso|Appt)\.? \d+[A-Za-z]?,? )?\d{{1,5}}[A-Za-z]? (?:[A-ZÀ-Þ][\w'’-]+ ){{1,3}}{SUFFIX}\b\.?"
    rf"|(?:[A-ZÀ-Þ][\w'’-]*(?:[sS]tra(?:ß|ss)e|[sS]tr\.|weg|gasse|platz|allee|ufer|damm)|[A-ZÀ-Þ][\w'’-]* (?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee)) \d{{1,4}} ?[a-z]?\b"
    rf"|\d{{1,5}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée) (?:de la |de l['’]|des |du |de |d['’])?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|C/) (?:de la |del |de los |de las |de )?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*,? (?:n[.º°]* ?)?\d{{1,4}})"
    rf"(?:,?\s+(?:\d{{4,5}} )?{TOWN}(?: \d{{5}}\b)?)?"
)
PART = r"[A-ZÀ-Þ][a-zà-ÿ'’]+(?:-[A-ZÀ-Þ][a-zà-ÿ'’]+)*"
UPPER = r"[A-ZÀ-Þ]{2,}(?:-[A-ZÀ-Þ]{2,})*"
INITIAL = r"[A-ZÀ-Þ]\."
NAME = re.compile(
    rf"(?<![\w@#&./-])(?:{PART}, (?:{PART})(?: {INITIAL})*(?: {PART})?|(?:{INITIAL} ?)+(?:{PART})|{PART}(?: {INITIAL})* (?:(?:van|von|de|der|del|di|da|la|le) )*{PART}(?: {PART})?"
    rf"|{UPPER},? {UPPER}|{PART}, {INITIAL})(?![\w@(_-]|\.\w)"
)
ARTICLES = {"the", "a", "an", "der", "die", "das", "ein", "eine", "le", "la", "les", "el", "los", "las", "un", "une", "una"}
#: Left off a name like articles, but they also stand before persons ("heard that").
POINTERS = {"this", "that"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "madam", "herr", "frau", "señor", "señora", "sr", "sra", "monsieur", "madame", "mme", "tutor", "professor", "doctor", "doktor", "dipl", "ing"}
WORDS_NEAR = {
    "phone": ["phone", "call", "ring", "tel", "telephone", "mobile", "number", "fax", "reach", "telefon", "anrufen", "teléfono", "téléphone", "handy"],
    "id_number": ["passport", "tax", "social", "student", "id", "ssn", "insurance", "matr", "matrikel", "steuer", "ausweis", "pasaporte", "impuesto", "passeport", "identity", "number", "mine"],
}
AGAINST = ["ticket", "part", "checksum", "version", "sizes", "size", "page", "port", "serial", "build", "isbn", "error", "index", "room", "dates", "date", "commit", "line"]
TOKEN = re.compile(r"[A-Za-zÀ-ÿ]+")


def luhn(digits: str) -> bool:
    """Card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(text: str) -> bool:
    """Account numbers."""
    t = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in t)) % 97 == 1


def mod23(text: str) -> bool:
    """Spanish identity numbers: the letter at the end is the rest by 23."""
    number = text[:-1].translate(str.maketrans("XYZ", "012"))
    return text[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23]


def mod11_10(digits: str) -> bool:
    """German tax numbers: a running rest by 11 and 10."""
    rest = 10
    for c in digits[:-1]:
        rest = (rest + int(c)) % 10 or 10
        rest = rest * 2 % 11
    return digits[0] != "0" and (11 - rest) % 10 == int(digits[-1])


def key97(digits: str) -> bool:
    """French social numbers: the last two digits complete the rest by 97."""
    return 97 - int(digits[:-2]) % 97 == int(digits[-2:])


#: Where any of the shapes below may begin: all have a digit behind four letters and a sign at the latest.
ID_BEGIN = re.compile(r"(?<![\w./#-])(?=[A-Za-z]{0,4}[ -]?\d)")
# Shapes of identity numbers, with the score of the shape alone and the check that confirms it, if the number has one.
ID_SHAPES = [
    (0.7, re.compile(r"(?<![\w./#-])\d{3}([ -])\d{2}\1\d{4}(?![\w-]|[./]\d)"), None),  # social or tax number
    (0.8, re.compile(r"(?<![\w./#-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"), None),  # national insurance
    (0.8, re.compile(r"(?<![\w./#-])QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"), None),
    (0.7, re.compile(r"(?<![\w./#-])\d{2}/\d{3}/\d{5}(?![\w-]|[./]\d)"), None),  # tax office number
    (0.7, re.compile(r"(?<![\w./#-])[A-Z]\d{8}(?![\w-])"), None),  # passport
    (0.8, re.compile(r"(?<![\w./#-])(?:MAT|MATR|STU|STUD|SID|REG)-\d{4}-\d{4}(?![\w-])"), None),  # student
    (0.6, re.compile(r"(?<![\w./#-])[a-z]\d{7}(?![\w-])"), None),  # student login
    (0.4, re.compile(r"(?<![\w./#-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\w-])"), mod97),  # account
    (0.4, re.compile(r"(?<![\w./#-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])"), luhn),  # card
    (0.3, re.compile(r"(?<![\w./#-])(?:\d{8}|[XYZ]-?\d{7})-?[A-Z](?![\w-])"), mod23),
    (0.05, re.compile(r"(?<![\w./#-])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w-]|[./]\d)"), mod11_10),
    (0.2, re.compile(r"(?<![\w./#-])[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w-]|[./]\d)"), key97),
]


def _near(text: str, start: int, kind: str) -> float:
    """What the words up to 40 characters before the span add to its score."""
    before = [w.lower() for w in TOKEN.findall(text[max(0, start - 40) : start].rpartition("\n")[2])]
    score = 0.3 if any(w in WORDS_NEAR.get(kind, ()) for w in before[-5:]) else 0.0
    return score - (0.6 if any(w in AGAINST for w in before[-2:]) else 0.0)


def find_spans(text: str, least: float = 0.5) -> list[tuple]:
    """Spans of one text as (type, start, end, score, words of a name, where its run begins, whether an article stands before
    it, whether it stands within a sentence). Spans never overlap, but a run of capitalised words may give several; these
    still have to pass the check of their words against the collection's."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []  # in order, never overlapping

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b, -1))
        return not i or taken[i - 1][1] <= a

    def add(kind: str, a: int, b: int, score: float) -> None:
        if score >= least and free(a, b):
            out.append((kind, a, b, round(score, 2), None, a, False, False))
            insort(taken, (a, b))

    # most texts have nothing that a mailbox can't do without
    for shape, sign in ((EMAIL, AT_SIGN), (SAID_EMAIL, SAID_DOT)):
        for m in shape.finditer(text) if sign.search(text) else ():
            add("email", m.start(), m.end(), 0.9 if PLAIN_EMAIL.fullmatch(m.group(0)) else 0.7)
    for m in ADDRESS.finditer(text):
        add("street_address", m.start(), m.end(), 0.8)
    begins = [m.start() for m in ID_BEGIN.finditer(text)]
    for base, shape, check in ID_SHAPES:
        end = 0
        for at in begins:
            m = shape.match(text, at) if at >= end else None
            if not m:
                continue
            score, end = base, m.end()
            if check:
                score += 0.4 if check(re.sub(r"[ -]", "", m.group(0))) else -0.4
            add("id_number", m.start(), m.end(), score + _near(text, m.start(), "id_number"))
    for m in PHONE.finditer(text):
        n = sum(c.isdigit() for c in m.group(0))
        if 7 <= n <= 15:
            add("phone", m.start(), m.end(), (0.7 if m.group(0)[0] in "+(0" else 0.6) + _near(text, m.start(), "phone"))
    for m in NAME.finditer(text):
        a = m.start()
        if not free(a, m.end()):
            continue
        parts = [(x.start() + a, x.end() + a, x.group(0)) for x in re.finditer(r"[^\W\d_](?:[\w'’-]*[^\W\d_])?\.?", m.group(0))]
        before = TOKEN.findall(text[max(0, a - 12) : a])
        article = bool(before) and text[a - 1] == " " and before[-1].lower() in ARTICLES
        titled = bool(before) and before[-1].lower() in TITLES
        while parts and (parts[0][2].rstrip(".").lower() in TITLES or parts[0][2].lower() in ARTICLES | POINTERS):
            first = parts.pop(0)[2].rstrip(".").lower()
            article |= first in ARTICLES
            titled |= first in TITLES
        line = text[max(0, a - 12) : a].rpartition("\n")[2].rstrip(" ")
        within = bool(line) and (line[-1].islower() or line[-1] == ",")
        # which parts are common words is only known later: without its first or last part the rest may be the name
        tries = [parts, parts[1:], parts[:-1]] if len(parts) > 2 else [parts]
        for i, k in enumerate(tries):
            if len(k) > 1:
                words = [p.lower() for *_, q in k for p in q.split("-") if len(p.rstrip(".")) > 1]
                out.append(("person_name", k[0][0], k[-1][1], TITLED if titled else NAMED, words, a, article, within and i != 1))
    return sorted(out, key=lambda x: x[1])


SPANS = "id bigint, pii_type string, start_char int, end_char int, score double, parts array<string>, run int, article boolean, within boolean"
#: Scores of a run of capitalised words, without and with a title before it.
NAMED, TITLED = 0.7, 0.8


def _span_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["id", "pii_type", "start_char", "end_char", "score", "parts", "run", "article", "within"]
    for pdf in batches:
        yield pd.DataFrame([(key, *s) for key, text in zip(pdf["id"], pdf["text"]) for s in find_spans(text)], columns=cols)


def lower_shares(texts: DataFrame) -> DataFrame:
    """How often the collection writes a word in lower case: ``word, share`` of all its occurrences, words never so written left out.

    Mailboxes are left out first: they hold names in lower case. Counts combine map-side.
    """
    # by blank-separated pieces: a pattern that looks for the ends of a mailbox would be quadratic in a very long piece
    piece = texts.select(F.explode(F.split("text", r"\s+")).alias("p")).where(~F.col("p").rlike(r"(?i)@|&#64;|&commat;|[(\[{](at|a)[)\]}]|://"))
    w = piece.select(F.explode(F.regexp_extract_all("p", F.lit(r"(?<![\p{L}\p{N}_.@+-])\p{L}{2,}+(?![\p{N}_@]|[.+]\p{L})"), F.lit(0))).alias("w"))
    c = w.groupBy(F.lower("w").alias("word")).agg(F.sum(F.when(F.col("w") == F.lower("w"), 1).otherwise(0)).alias("low"), F.count(F.lit(1)).alias("n"))
    return c.where("low > 0").select("word", (F.col("low") / F.col("n")).alias("share"))


#: Words that begin sentences or name things and may never stand in lower case in a small collection.
STARTERS = ["thanks", "thank", "ask", "send", "please", "parcel", "hello", "hi", "dear", "regards", "cheers", "see", "write", "my", "the", "this", "that", "and", "for", "but", "lab", "kit", "section", "die", "der", "das", "mein", "danke", "gracias", "merci", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "street", "road", "university", "chapter", "exercise", "week", "part", "room", "flat"]


def name_scores(names: DataFrame, shares: DataFrame) -> DataFrame:
    """``parts, within, penalty`` for every distinct run of words proposed as a name.

    Two things speak against a name, both by their share of all occurrences and neither by a single one: its commonest word is
    written in lower case elsewhere (full weight from a share of 0.1), and it follows an article (so much as that half the time is too much). A
    common word weighs less if the run stands within a sentence and the other words are never written small: "mark" and "rose" are
    words and given names. A word that several such runs have, as given and family names do, speaks for it a little.
    """
    runs = names.groupBy("parts").agg(F.count_if("article").alias("k"), F.count(F.lit(1)).alias("n"))
    words = runs.select("parts", F.explode("parts").alias("word"))
    met = words.groupBy("word").agg(F.count(F.lit(1)).alias("met"))
    each = words.join(met, "word").join(shares, "word", "left")
    share = F.coalesce("share", F.lit(0.0))
    common = each.groupBy("parts").agg(F.max(share).alias("most"), F.count_if(share > 0.01).alias("commons"), F.max("met").alias("met"))
    j = runs.join(common, "parts").withColumn("within", F.explode(F.array(F.lit(True), F.lit(False))))
    word = 0.4 * F.least(F.lit(1.0), F.col("most") / 0.1)
    kin = F.when(F.col("met") > 2, 0.05).otherwise(0.0)
    lone = F.col("within") & (F.col("commons") == 1)
    return j.select("parts", "within", (F.when(lone, F.least(word, F.lit(0.2))).otherwise(word) + 0.45 * F.col("k") / F.col("n") - kin).alias("penalty"))


def personal_spans(texts: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, pii_type, start_char, end_char, score`` for every mailbox, phone, identity number, address and name.

    ``texts(id, text)``. The score of a name depends on how the collection uses its words (``name_scores``), which a join
    decides: neither the words nor the names are ever gathered. Null and empty texts have no spans; whole texts are read,
    however long; repeated rows give repeated spans.
    """
    t = texts.where("text is not null and text <> ''")
    spans = cut(t.select(F.col("id").cast("bigint").alias("id"), "text").mapInPandas(_span_rows, SPANS))
    names = spans.where("pii_type = 'person_name'")
    told = t.sparkSession.createDataFrame([(w, 1.0) for w in STARTERS], "word string, share double")
    shares = lower_shares(t).unionByName(told).groupBy("word").agg(F.max("share").alias("share"))
    scored = names.join(name_scores(names, shares), ["parts", "within"]).withColumn("score", F.round(F.col("score") - F.col("penalty"), 2)).where(F.col("score") >= least)
    kept = scored.groupBy("id", "run").agg(F.max_by(F.struct("start_char", "end_char", "score"), F.col("end_char") - F.col("start_char")).alias("s"))
    kept = kept.select("id", F.lit("person_name").alias("pii_type"), "s.start_char", "s.end_char", "s.score")
    return spans.where("pii_type <> 'person_name'").select("id", "pii_type", "start_char", "end_char", "score").unionByName(kept)


def redacted(texts: DataFrame) -> DataFrame:
    """``id, text`` with a typed placeholder such as ``<EMAIL>`` in place of every span; the rest stays as it is."""
    spans = personal_spans(texts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("spans"))
    j = texts.select(F.col("id").cast("bigint").alias("id"), "text").join(spans, "id", "left")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in zip(pdf["text"], pdf["spans"]):
                if found is not None:
                    at, parts = 0, []
                    for s in found:
                        parts += [text[at : s["start_char"]], f"<{s['pii_type'].upper()}>"]
                        at = s["end_char"]
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pd.DataFrame({"id": pdf["id"], "text": out})

    return j.mapInPandas(fill, "id bigint, text string")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(_texts(spark, d)).select(F.col("id").alias("doc_id"), "pii_type", F.col("start_char").cast("bigint").alias("start_char"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(_texts(spark, d)).withColumnRenamed("id", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
