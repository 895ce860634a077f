"""Personal information in free text: found by kind and replaced by typed placeholders.

Names follow information-theoretic sanitisation. Known persons are the protected entities; the corpus tells for every term
beside them how much it reveals: the log ratio of its share of occurrences beside a protected term to that share over all
terms. Terms above the disclosure threshold are protected too, known or not, and reveal further terms in turn until none are
found. Numbers, addresses and mail have forms of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.session import is_small, materialise, small

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Forms of address before a surname (lower case).
TITLES = frozenset("herr frau mr mrs ms miss dr prof professor sir madam".split())

_WORD = re.compile(r"[^\W\d_]+")

_AT = r"(?:\s?[@＠]\s?|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
_LABEL = r"[a-z0-9][a-z0-9-]*"
EMAIL = re.compile(rf"[a-z0-9][a-z0-9._%+-]*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,}}|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})+)", re.I)

# What names a number that an authority or insurer gave to a person.
_ID_CUE = (
    r"passport|reisepass|\bssn\b|social security|driv(?:ing|er'?s?) licen[cs]e|licen[cs]e (?:no|number)|führerschein|tax id|taxpayer id|steuer-?(?:id|nummer|identifikationsnummer)|national id(?:entity)?"
    r"|identity card|id card|ausweis|(?:health )?insurance (?:no|number)|versicherungsnummer|national insurance|\bni number|\bni no|证件号?|身份证?|护照|社保|税号|驾照|驾驶证|医保"
)
ID_NUMBER = re.compile(rf"(?:{_ID_CUE})(?:[\s.:：#,-]|\b(?:no|nr|number|nummer|is|ist|lautet|id)\b|号码?|信息|卡|是|为|证|护照){{0,6}}([a-z]{{0,5}}[ -]?\d[\da-z]*(?:[ -][\da-z]*\d[\da-z]*|[ -][a-z]\b)*)", re.I)
_LONG_ID = re.compile(r"(?<![\da-z])[1-9]\d{16}[\dx](?![\da-z])", re.I)

_EXT = r"(?:\s*(?:ext|x|durchwahl|转)\.?\s*\d{1,5})?"
#: Full numbers, by the ways countries write them.
PHONE = re.compile(
    rf"(?<![a-z0-9_#/.-])(?:tel:)?(?:\+\d{{1,3}}[\s.-]?(?:\(\d{{1,4}}\)[\s.-]?)?\d(?:[\s.-]?\d){{6,12}}|[(（]0?\d{{2,4}}[)）][\s.-]?\d{{3,4}}[\s.-]?\d{{3,5}}|1[.-]\d{{3}}[.-]\d{{3}}[.-]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|0\d{{4}}[ -]\d{{6}}|00\d{{2}}[ -]\d{{1,4}}[ /-]\d{{3,8}}(?:[ -]\d{{2,5}})?"
    rf"|0\d{{1,4}}[ /-]\d{{3,8}}(?:[ -]\d{{2,5}})?|1\d{{2}}[ -]?\d{{4}}[ -]?\d{{4}}){_EXT}(?![a-z0-9_-]|\.\d)",
    re.I,
)
_PHONE_CJK = re.compile(r"(?<=[㐀-鿿：:])(?:\+86[\s-]?)?(?:1\d{2}[ -]?\d{4}[ -]?\d{4}|[(（]0\d{2,3}[)）]\s?\d{7,8}|0\d{2,3}[ -]\d{7,8}|\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d(?:[\s.-]?\d){6,12})(?!\d)")
#: Short local numbers count only after a word that announces a telephone.
_LOCAL = re.compile(r"(?<![A-Za-z0-9_#/.-])\d{3}[-. ]\d{4}(?![A-Za-z0-9_-]|\.\d)")
_PHONE_CUE = re.compile(r"\b(?:call|text|phone|telephone|tel|mobile|cell|fax|ring|dial|desk picks up on|number (?:changed|is)|reach (?:me|us)|rufen|telefon|handy|anruf|rückruf)\b|电话|手机|拨打|请打|有事", re.I)
_NOT_PHONE = re.compile(r"(?:order|code|part number|isbn\S*|build|ticket|invoice|batch|lauf|version|serial|run|工单|编号|订单|bestellung|auftrag)\W{0,3}(?:is|no\.?|nr\.?|number)?\W{0,3}$", re.I)

_STREET = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|boulevard|blvd|way|terrace|place|square|crescent|row|gardens"
ADDRESS = (
    re.compile(rf"(?:\b(?:flat|unit|apt|apartment|suite)\.?\s+\d{{1,4}}\s?[a-z]?,\s+)?(?<![a-z0-9_#.:/-])\d{{1,5}}[a-z]?\s+(?:[^\W\d_]+\s+){{1,2}}(?:{_STREET})\b\.?(?:,\s+(?:apt|unit|flat)\.?\s+\w+)?(?:(?:,\s+|\s*\n\s*|\s+in\s+)[^\W\d_]{{3,}}(?:\s+\d{{5}})?)", re.I),
    re.compile(r"(?<!\w)[^\W\d_]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|steig|chaussee)\s+\d{1,4}\s?[a-z]?\b(?:,\s*\d{5}\s+[^\W\d_]+)?", re.I),
    re.compile(r"(?<!\w)(?:[^\W\d_]+\s+){1,3}\d{1,4}\s?[a-z]?,\s*\d{5}\s+[^\W\d_]{3,}", re.I),
    re.compile(r"[㐀-鿿]{1,12}(?:路|街|巷|大道|弄|胡同|道)\s?\d{1,5}\s?号(?:\s?\d+\s?(?:号楼|栋|幢|楼|室|单元|层))*"),
)
#: What each address pattern cannot do without, quick to look for: a number led by words of a street, parts of street names, a postal code, 号.
_STREET_MARK = re.compile(rf"\d[a-z]?\s+(?:[^\W\d_]+\s+){{1,2}}(?:{_STREET})\b", re.I)
_STREET_PARTS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "steig", "chaussee")
_STREET_END = re.compile(r"[^\W_\d.]\.?\s+\d")
_POSTAL_MARK = re.compile(r"\d\s?[a-z]?,\s*\d{5}\s", re.I)
_HOUSE_MARK = re.compile(r"\d\s?号")
#: Parts in lower case of which every cue of an identity number holds one.
_ID_PARTS = tuple("passport|reisepass|ssn|social security|licen|führerschein|tax id|taxpayer id|steuer|national i|identity card|id card|ausweis|insurance n|versicherungsnummer|ni n|证件|身份|护照|社保|税号|驾照|驾驶|医保".split("|"))
_DIGIT = re.compile(r"\d")
_NUMBER_MARK = re.compile(r"\d(?:[\s().（）/-]{0,2}\d){6}")


def _folded(text: str) -> str:
    """Lower case, with the letters that ``re.I`` takes for plain ones."""
    for c, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")):
        text = text.replace(c, plain)
    return text.lower()


def _id_numbers(text: str, low: str) -> bool:
    """False only where ``ID_NUMBER`` can find no number of six digits."""
    return any(p in low for p in _ID_PARTS) and len(_DIGIT.findall(text)) >= 6


def _addresses(text: str, low: str) -> Iterator[re.Pattern]:
    """The patterns of ``ADDRESS`` that may find something."""
    if _STREET_MARK.search(text):
        yield ADDRESS[0]
    if any(p in low for p in _STREET_PARTS) and _STREET_END.search(text):
        yield ADDRESS[1]
    if _POSTAL_MARK.search(text):
        yield ADDRESS[2]
    if "号" in text and _HOUSE_MARK.search(text):
        yield ADDRESS[3]


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of mail addresses, identity numbers, telephone numbers and street addresses, without overlap, in this order of right."""
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if b > a and all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    low = _folded(text)
    if "@" in text or "＠" in text or ("at" in low and ("dot" in low or "[at" in low or "(at" in low or "{at" in low or " at]" in low or " at)" in low)):
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    if not _DIGIT.search(text):  # all other forms hold one
        return found
    long_number = _NUMBER_MARK.search(text) is not None
    if _id_numbers(text, low):
        for m in ID_NUMBER.finditer(text):
            if sum(c.isdigit() for c in m.group(1)) >= 6:
                add(*m.span(1), "id_number")
    if long_number:
        for m in _LONG_ID.finditer(text):
            add(*m.span(), "id_number")
        for pattern in (PHONE, _PHONE_CJK):
            for m in pattern.finditer(text):
                if not _NOT_PHONE.search(text[max(0, m.start() - 24) : m.start()]):
                    add(*m.span(), "phone")
        for m in _LOCAL.finditer(text):
            before = text[max(0, m.start() - 32) : m.start()]
            if _PHONE_CUE.search(before) and not _NOT_PHONE.search(before):
                add(*m.span(), "phone")
    for pattern in _addresses(text, low):
        for m in pattern.finditer(text):
            add(*m.span(), "address")
    return found


def name_spans(text: str, given: frozenset[str], surnames: frozenset[str]) -> list[tuple[int, int]]:
    """Given name with surname in any order and case, with an initial between, or a surname with a title or initial."""
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    low = [lowered(w) for w, _, _ in words]
    spans = []

    def gap(i: int) -> str:
        return text[words[i][2] : words[i + 1][1]]

    def spaced(i: int) -> bool:
        g = gap(i)
        return bool(g) and not g.strip()

    def after_dot(i: int) -> bool:
        return gap(i).strip() in (".", "") and gap(i) != ""

    for i, w in enumerate(low):
        if w not in surnames:
            continue
        start, end = words[i][1], words[i][2]
        if i and low[i - 1] in given and spaced(i - 1):
            spans.append((words[i - 1][1], end))
        elif i > 1 and len(low[i - 1]) == 1 and low[i - 2] in given and after_dot(i - 1) and spaced(i - 2):
            spans.append((words[i - 2][1], end))
        elif i and (low[i - 1] in TITLES or (len(low[i - 1]) == 1 and low[i - 1].isascii() and "." in gap(i - 1))) and after_dot(i - 1):
            spans.append((words[i - 1][1], end))
        elif i + 1 < len(low) and low[i + 1] in given and gap(i).strip() in (",", "") and gap(i) != "":
            spans.append((start, words[i + 1][2]))
        elif i + 1 < len(low) and len(low[i + 1]) == 1 and gap(i).strip() == "," and text[words[i + 1][2] : words[i + 1][2] + 1] == ".":
            spans.append((start, words[i + 1][2] + 1))
    return spans


def lowered(text: str) -> str:
    """Lower case, character by character where the whole text would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _automaton(terms):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    if len(found):
        found.make_automaton()
    return found


def _hits(found, low: str) -> Iterator[tuple[int, int, str]]:
    """Whole-word occurrences of the automaton's terms."""
    if not len(found):
        return
    for end, term in found.iter(low):
        a, b = end + 1 - len(term), end + 1
        before, after = low[a - 1 : a], low[b : b + 1]
        if (before.isalpha() and before < "㐀") or (after.isalpha() and after < "㐀"):
            continue
        yield a, b, term


_NEXT = re.compile(r"\s+(?:[A-Za-z]\.\s+)?([^\W\d_]{2,})")
_BEFORE = re.compile(r"([^\W\d_]{2,})\s+(?:[A-Za-z]\.\s+)?$")

_COMMA = re.compile(r"([^\W\d_]{2,}),\s+$")


def _beside(texts: DataFrame, given: set[str], surnames: set[str]) -> DataFrame:
    """Terms right after protected given names and titles or right before protected surnames: ``term``, ``role``, ``c``; counted before the shuffle."""
    lead, tail = sorted(given | TITLES), sorted(surnames)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leads, tails, n = _automaton(lead), _automaton(tail), Counter()
        for pdf in batches:
            for text in pdf["content"]:
                low = lowered(text)
                for a, b, t in _hits(leads, low):
                    m = _NEXT.match(text, b)
                    # after a title only a capital tells a name
                    if m and (t not in TITLES or (text[a].isupper() and m.group(1)[0].isupper())):
                        n[m.group(1).lower(), "surname"] += 1
                    m = _COMMA.search(text, max(0, a - 40), a) if t not in TITLES else None
                    if m:
                        n[m.group(1).lower(), "surname"] += 1
                for a, _, _ in _hits(tails, low):
                    m = _BEFORE.search(text, max(0, a - 40), a)
                    if m and m.group(1).lower() not in TITLES:
                        n[m.group(1).lower(), "given"] += 1
        yield pd.DataFrame([(t, r, c) for (t, r), c in n.items()], columns=["term", "role", "c"])

    return texts.mapInPandas(count, "term string, role string, c bigint").groupBy("term", "role").agg(F.sum("c").alias("c"))


def _occurrences(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """How often each of ``terms`` (``term``) occurs in the corpus: ``term``, ``n``. Up to ``most`` terms are sent to the tasks; beyond that all words are counted and joined."""
    if not is_small(terms, most):
        words = texts.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}&&[^\x{3400}-\x{9FFF}]]+)"), 1)).alias("term"))
        return words.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    listed = [r.term for r in terms.collect()]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = _automaton(listed), Counter()
        for pdf in batches:
            for text in pdf["content"]:
                for _, _, t in _hits(found, lowered(text)):
                    n[t] += 1
        yield pd.DataFrame(list(n.items()), columns=["term", "n"])

    return texts.mapInPandas(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def disclosure(texts: DataFrame, persons: list[str], *, threshold_bits: float = 8.0, share: float = 0.2, least: int = 1, rounds: int = 8, max_terms: int = 200_000) -> tuple[frozenset[str], frozenset[str]]:
    """Protected given names and surnames (lower case): those of ``persons`` and the terms that reveal persons.

    A term's disclosure is log2 of (its share of occurrences beside a protected term) over (that share for all words). Terms are
    protected if they occur so at least ``least`` times, in at least ``share`` of their occurrences, with at least
    ``threshold_bits``. Protected terms reveal further ones, until a round finds none (or ``rounds`` are over). Counts are over
    the whole corpus and stay in Spark; only protected names reach the driver, and more than ``max_terms`` raise ``ValueError``.
    """
    known = [p.lower().split() for p in persons if p and len(p.split()) >= 2]
    given, surnames = {p[0] for p in known}, {p[-1] for p in known}
    if not given:
        return frozenset(), frozenset()
    spark = texts.sparkSession
    n_words = texts.agg(F.sum(F.length("content") - F.length(F.replace("content", F.lit(" "))) + 1)).first()[0] or 1
    ruled_out = base = None
    for _ in range(rounds):
        beside = materialise(_beside(texts, given, surnames).where(F.col("c") >= least), "beside")
        if base is None:  # as the known persons alone set it
            base = max(1, beside.agg(F.sum("c")).first()[0] or 0) / n_words
        protected = spark.createDataFrame([(t, "given") for t in given] + [(t, "surname") for t in surnames] + [(t, r) for t in TITLES for r in ("given", "surname")], "term string, role string")
        new = beside.join(small(protected), ["term", "role"], "left_anti")
        if ruled_out is not None:
            # a term that fell short before, with no more occurrences beside names, falls short again
            new = new.join(ruled_out.select("term", "role", "c"), ["term", "role", "c"], "left_anti")
        seen = materialise(new.join(_occurrences(texts, new.select("term").distinct(), max_terms), "term").withColumn("own", F.col("c") / F.greatest("c", "n")), "seen")
        telling = (F.col("own") >= share) & (F.log2(F.col("own") / base) >= threshold_bits)
        names = seen.where(telling).select("term", "role").limit(max_terms + 1).collect()
        if len(names) + len(given) + len(surnames) > max_terms:
            raise ValueError("more names than max_terms: raise it and the memory of the tasks")
        if not names:
            break
        ruled_out = seen.where(~telling) if ruled_out is None else ruled_out.unionByName(seen.where(~telling))
        for r in names:
            (given if r.role == "given" else surnames).add(r.term)
    return frozenset(given), frozenset(surnames)


def sanitise(records: DataFrame, entities: DataFrame, **limits) -> DataFrame:
    """Records with personal information: ``rec_id``, ``kinds`` (sorted, distinct) and ``clean``, the text with typed placeholders.

    ``records`` needs ``rec_id`` and ``content``, ``entities`` ``entity`` and ``placeholder`` (persons are those whose placeholder
    names a PERSON); further columns are not read. Records without findings and with null or empty content give no row; each
    repeated record gives its own. Texts are read whole. ``entities`` is a fixed list, read to the driver; more than
    ``max_terms`` persons raise ``ValueError``. A person of one word is found as that word, one in ideographs anywhere.
    """
    texts = records.where(F.length("content") > 0).select("rec_id", "content")
    most = limits.get("max_terms", 200_000)
    persons = [r.entity for r in entities.where(F.col("placeholder").contains("PERSON") & (F.length(F.trim("entity")) > 0)).select("entity").distinct().limit(most + 1).collect()]
    if len(persons) > most:
        raise ValueError("more persons than max_terms: raise it and the memory of the tasks")
    # names of one word, or written without spaces, have no parts to meet: they are searched whole
    whole = sorted({p.strip().lower() for p in persons if len(p.split()) == 1})
    given, surnames = disclosure(texts.select("content"), persons, **limits)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named, alone = _automaton(surnames), _automaton(whole)
        for pdf in batches:
            rows = []
            for rec_id, text in zip(pdf["rec_id"], pdf["content"], strict=True):
                spans = fixed_spans(text)
                low = lowered(text)
                names = name_spans(text, given, surnames) if next(_hits(named, low), None) else []
                for a, b in names + sorted(((a, b) for a, b, _ in _hits(alone, low)), key=lambda s: s[0] - s[1]):
                    if all(b <= x or a >= y for x, y, _ in spans):
                        spans.append((a, b, "name"))
                if not spans:
                    continue
                out, at = [], 0
                for a, b, kind in sorted(spans):
                    out += [text[at:a], PLACEHOLDER[kind]]
                    at = b
                rows.append((rec_id, sorted({k for _, _, k in spans}), "".join(out) + text[at:]))
            yield pd.DataFrame(rows, columns=["rec_id", "kinds", "clean"])

    return texts.mapInPandas(find, "rec_id string, kinds array<string>, clean string")
