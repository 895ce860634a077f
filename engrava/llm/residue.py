"""Template residue, filler text, error pages and script notices that stand where content should be.

Detectors read each record on its own: slots, repeated units, error, notice or filler wording, and how much remains beside
that. What remains is judged by the corpus: responses repeat the wording of other responses from many hosts, which real
sentences do not. A record whose remaining words all stand in such shared wording, under an address and title without a
term of its body, is a response and not content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrava.functions.text import INVISIBLE
from engrava.session import materialise, small

_NAME = r"[\p{L}][\p{L}\p{N}_ .-]{0,80}"
#: Forms of an unfilled slot, by the template languages that write them.
SLOT = (
    rf"(?i)\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|[$#]\{{\s*{_NAME}\s*\}}|%\({_NAME}\)[sd]?|<<\s*{_NAME}\s*>>|«\s*{_NAME}\s*»"
    rf"|@@{_NAME}@@|__{_NAME}?__|%{_NAME}%|\[\[\s*{_NAME}\s*\]\]|\[\s*{_NAME}\s*\]|\((?:insert|enter|your) [^()]{{1,40}}\)"
    rf"|\{{\s*{_NAME}\s*\}}|<{_NAME}>"
)
_TAGS = r"(?i)(?<!<)</?(?:!doctype|html|head|title|body|h[1-6]|p|div|noscript|br|hr|b|i|em|strong|span|center|a|ul|ol|li|pre|code|meta|script|style|section|main|header|footer|table|tr|td)\b[^<>]*>(?!>)"
#: Markers that cut a text short; they are no slots.
_CUTS = r"\[(?:truncated|redacted|image|file|audio|video)\]"

_SCRIPTS = r"(?:javascript|java script|\bjs\b|\b(?:client-side )?scripts?\b|\bscripting\b|\bskripte?n?\b)"
# Wording of error and denial pages, of notices that scripts or a browser check are required, and of filler and
# sample text (lower case). Each pattern follows its triggers: one of these words must occur for the pattern to match.
_SCRIPT_WORDS = "javascript java js script scripts scripting skript skripte skripten"
_WORDING = (
    ("http error status fehler fehlercode", r"\b(?:http(?: status| error)?|error(?: code)?|status(?: code)?|fehler(?:code)?)\s*[:#-]?\s*[45]\d\d\b"),
    (
        "found forbidden unauthorized request gateway unavailable requests internal gone method payment conflict",
        r"\b(?:not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|request time-?out|service (?:temporarily )?unavailable|too many requests|internal server error|gone|method not allowed|payment required|conflict)\b(?:\s*\(?[45]\d\d\)?)?",
    ),
    ("denied permission sign log", r"\baccess (?:is |was )?denied\b|\bpermission denied\b|\byou (?:do not|don't) have permission\b|\b(?:sign|log) in to (?:view|see|read|continue)\b"),
    (
        "could can't can’t cannot cant application exception exist longer wrong maintenance did later upstream connection server unexpected",
        r"\bcould not (?:load|open|be served|be found|find)\b|\bcan(?:no|'|’)t (?:find|open|load|reach) (?:that|this|the)\b|\bcan(?:no|'|’)t be (?:reached|found|loaded|opened|displayed|shown)\b|\bapplication error\b|\bexception occurred\b|\bdoes not exist\b|\bno longer available\b|\bsomething went wrong\b|\bdown for maintenance\b"
        r"|\bdid not answer\b|\b(?:please )?try again later\b|\bupstream (?:returned|error)\b|\bconnection (?:refused|reset|timed out)\b|\bserver said\b|\bunexpected error\b",
    ),
    ("zugriff gefunden erreichbar interner berechtigung anfragen existiert verfügbar", r"\bzugriff verweigert\b|\bnicht gefunden\b|\bnicht erreichbar\b|\binterner serverfehler\b|\bkeine berechtigung\b|\bzu viele anfragen\b|\bexistiert nicht\b|\bnicht (?:mehr )?verfügbar\b"),
    (_SCRIPT_WORDS, rf"\b(?:enable|activate|allow|turn on|switch on|turned on|requires?|needs?|relies on|without|works? with|unblock)\b.{{0,30}}{_SCRIPTS}"),
    (_SCRIPT_WORDS, rf"{_SCRIPTS}.{{0,30}}\b(?:disabled|blocked|off|not available|unavailable|not enabled|required|turned on|enabled|to be on|not supported)\b"),
    (_SCRIPT_WORDS, rf"\b(?:aktivieren|ohne|benötigt|erlauben|einschalten|deaktiviert)\b.{{0,30}}{_SCRIPTS}|{_SCRIPTS}.{{0,30}}\b(?:aktivieren|deaktiviert|benötigt|erforderlich|erlauben|blockiert)\b"),
    ("browser human", r"\bchecking (?:if )?(?:your|the) browser\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b|\bbrowser (?:is )?(?:being )?checked\b|\bbrowser wird (?:über)?geprüft\b"),
    (
        "lorem placeholder place dummy untitled replace goes sample example default",
        r"\blorem\b|\bplace ?holder\b|\bdummy\b|\buntitled\b|\breplace (?:me|later|this)\b|\bgoes here\b|\bsample (?:text|paragraph|entry|content|sentence|title|note)\b|\bexample (?:text|entry|content|paragraph|sentence)\b|\b(?:sample|example|default|dummy) [a-z]+ \d+\b|\breplace (?:this|these|the) (?:text|sentence|words|paragraph)\b|\bdefault (?:text|title|caption|bullet|paragraph|heading|note|summary|content|entry|quote|label)\b",
    ),
    (
        "insert written supplied filled added completed soon text content tbd todo nothing layout",
        r"\binsert\b.{0,40}\bhere\b|\binsert\b.{0,40}\bbox\b|\bto be (?:written|supplied|filled|added|completed)\b|\bfilled in later\b|\bcoming soon\b|\byour (?:text|content)\b|\btext here\b|\btbd\b|\btodo\b|\bnothing to see\b|\bfor layout only\b",
    ),
    ("fülltext platzhalter blindtext beispieltext mustertext text", r"\bfülltext\b|\bplatzhalter\b|\bblindtext\b|\bbeispieltext\b|\bmustertext\b|\bhier (?:steht|kommt)\b.{0,20}\btext\b"),
)
_WORDING_CJK = (
    r"错误\s*[45]\d\d|页面不存在|服务器内部错误|无法(?:打开|显示)|访问被拒绝|拒绝访问|没有权限|找不到(?:该|此)?页面|请求过多|服务(?:暂时)?不可用|网关超时|访问过于频繁|内容已被?(?:删除|失效)|正在检查(?:您的)?浏览器|浏览器安全检查"
    r"|浏览器.{0,4}(?:启用|开启).{0,4}(?:javascript|js|脚本)|(?:启用|开启|允许|打开|需要|禁用|关闭).{0,8}(?:javascript|js|脚本)|(?:javascript|js|脚本).{0,8}(?:禁用|关闭|未启用|未开启|不可用)"
    r"|示例文本|占位|内容待补充|待补充|此处填写|请在此(?:处)?填写|请输入|测试文本|样例文字|示例内容|暂无内容"
)
#: Parts of which every match of the pattern above holds at least one.
_CJK_MARKS = tuple("页面 错误 无法 访问 没有权限 请求过多 不可用 网关超时 内容已 浏览器 javascript js 脚本 示例 占位 待补充 填写 请输入 测试文本 样例 暂无".split())
_STATUS = r"^[^\p{L}\p{N}]*[45]\d\d\b"
# The vocabulary of the Latin filler text (lower case).
LOREM_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
_HINT = "|".join(f"(?:{pattern})" for pattern in (_STATUS, *(p for _, p in _WORDING), _WORDING_CJK))
#: Parts of which every slot holds at least one: a cheap test before the pattern.
_SLOT_MARKS = ("{", "%", "<", "«", "@@", "__", "[", "(insert ", "(enter ", "(your ")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row; later filters on it are not pushed below and computed again."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _spaced(content: Column) -> Column:
    return F.trim(F.regexp_replace(content, rf"[{INVISIBLE}]+", " "))


def _plain(content: Column) -> Column:
    """Without markup and marks of truncation, white space of any kind to one space."""
    return _spaced(F.regexp_replace(F.regexp_replace(content, _TAGS, " "), _CUTS, " "))


def _words(low: Column) -> Column:
    """Alphabetic words of lower-case text."""
    return F.regexp_extract_all(low, F.lit(r"([a-zß-öø-ÿ]+(?:['’-][a-zß-öø-ÿ]+)*)"), 1)


def _pieces(low: Column) -> Column:
    """Words and numbers of lower-case text, and single ideographs."""
    return F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+)"), 1)


def _tokens(low: Column) -> Column:
    """Alphabetic words and single ideographs of lower-case text, in order."""
    return F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FFF}]|[a-zß-öø-ÿ]+(?:['’-][a-zß-öø-ÿ]+)*)"), 1)


def _grams(tokens: Column) -> Column:
    """Pairs of neighbouring tokens as 64-bit hashes; the last token stands with the end."""
    return F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.xxhash64(a, b))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each of ``_grams`` of ``tokens``, as ``gram``, with the ``keys``."""
    return rows.select(*keys, F.inline(F.arrays_zip(F.col("tokens").alias("a"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("b")))).select(*keys, F.xxhash64("a", "b").alias("gram"))


def _ideographs(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}]+", ""))


def _without_references(c: Column) -> Column:
    """Without paths, addresses, request numbers and codes."""
    return F.regexp_replace(c, r"(?i)https?://\S+|(?<![\p{L}\p{N}])/[^\s.,<>\"]*|\b(?:ref|ray|trace|request|error id|incident|id)\b[ :#]*[0-9a-f-]*\d[0-9a-f-]*|\bquote [a-z0-9-]+(?=\W*$|[.,]? |$)|\b[0-9a-f]*\d[0-9a-f]*\b|\d+", " ")


#: A unit of at most so many words or ideographs, repeated, is filler; a longer passage that repeats is not.
LONGEST_UNIT = 12


def _repeats(pieces: Column) -> Column:
    """Whether the pieces are one unit over and over: four times a single word, three times a longer unit, twice three ideographs or more."""

    def at(p: Column, u: Column) -> Column:
        rest = F.size(p) - u
        often = F.when(u == 1, 4).when((u >= 3) & F.forall(F.slice(p, 1, u), lambda x: x.rlike(r"^[\x{4E00}-\x{9FFF}]$")), 2).otherwise(3)
        return F.when(F.size(p) >= often * u, F.slice(p, 1, rest) == F.slice(p, u + 1, rest)).otherwise(F.lit(False))

    def stutters(w: Column) -> Column:
        """A word of one to six letters over and over, the last time perhaps cut."""
        return F.exists(F.sequence(F.lit(1), F.lit(6)), lambda u: (F.length(w) >= 4 * u) & (w == F.substring(F.repeat(F.substring(w, F.lit(1), u), F.ceil(F.length(w) / u).cast("int")), F.lit(1), F.length(w))))

    few = F.size(F.array_distinct(F.slice(pieces, 1, 3 * LONGEST_UNIT + 1))) <= LONGEST_UNIT + 1
    units = F.sequence(F.lit(1), F.lit(LONGEST_UNIT))
    return few & ((F.size(pieces) > 1) & F.exists(units, lambda u: at(pieces, u)) | F.forall(pieces, stutters) & (F.size(pieces) > 0))


def _words_literal(words: str | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set(words.split() if isinstance(words, str) else words))])


def _is_filler(low: Column, tokens: Column) -> Column:
    """Filler vocabulary, one unit repeated, or keyboard rows, in lower-case text with single spaces; the same tests at every length."""
    lorem = _words_literal(tuple(LOREM_WORDS))
    # ideographs are single, so these tokens are the words
    lorem_share = _let(F.filter(tokens, lambda x: F.length(x) > 1), lambda w: (F.size(w) >= 3) & (F.size(F.filter(w, lambda x: F.array_contains(lorem, x))) >= 0.8 * F.size(w)))
    plain_end = F.regexp_replace(low, r" [0-9a-f]*\d[0-9a-f]*$", "")
    mash = low.rlike("^[asdfghjklqwe]{2,8} [asdfghjklqwe]{2,8} ") & _let(F.split(plain_end, " "), lambda w: (F.size(w) > 2) & F.forall(w, lambda x: x.rlike("^[asdfghjklqwe]{2,8}$")))
    # cheap tests first: what repeats has few words at its start, and its first letters occur again
    few = F.size(F.array_distinct(F.slice(tokens, 1, 4 * LONGEST_UNIT))) <= 2 * LONGEST_UNIT
    head = F.regexp_extract(low, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]{1,3})", 1)
    again = F.instr(F.substring(low, F.instr(low, head) + 1, F.length(low)), head) > 0
    return (few & again & _let(_pieces(plain_end), _repeats)) | (F.arrays_overlap(tokens, lorem) & lorem_share) | mash


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def _hinted(low: Column, tokens: Column) -> Column:
    """Whether such wording is in the lower-case text; patterns run only where their triggers are."""
    some = F.lit(False)
    for triggers, pattern in _WORDING:
        some = some | (F.arrays_overlap(tokens, _words_literal(triggers)) & low.rlike(pattern))
    triggered = F.arrays_overlap(tokens, _words_literal(" ".join(triggers for triggers, _ in _WORDING)))
    return low.rlike(_STATUS) | (triggered & some) | (low.rlike(r"[\x{4E00}-\x{9FFF}]") & _contains_any(low, _CJK_MARKS) & low.rlike(_WORDING_CJK))


def _judge(content: Column) -> Column:
    """Row-local evidence as a struct: ``slots``, ``slot_rest`` (words beside slots), ``hint``, ``hint_rest`` (words beside hints) and, where there is a hint, the masked ``tokens``."""

    def of_plain(plain: Column) -> Column:
        low = F.lower(plain)
        beside = F.lower(_without_references(F.regexp_replace(plain, SLOT, " ")))
        slots = F.when(_contains_any(low, _SLOT_MARKS), F.size(F.regexp_extract_all(plain, F.lit(f"({SLOT})".replace("((?i)", "(?i)(")), 1))).otherwise(0)
        others = _without_references(F.regexp_replace(low, _HINT, " "))
        local = lambda n, hint: F.struct(n.alias("slots"), F.when(n > 0, F.size(_words(beside)) + 0.5 * _ideographs(beside)).alias("slot_rest"), hint.alias("hint"), F.when(hint, F.size(_words(others)) + 0.5 * _ideographs(others)).alias("hint_rest"), F.when(hint, _tokens(_without_references(low))).alias("tokens"))
        return _let(slots, lambda n: _let(_hinted(low, _tokens(low)), lambda hint: local(n, hint)))

    return _let(_plain(content), of_plain)


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}]{3,})"), 1)


def _seen(records: DataFrame, slot_words: float, words_per_slot: float, rest_words: float) -> DataFrame:
    """The few rows with slots, filler or such wording, written once: ``kind`` where the detectors are sure, the masked ``tokens`` where there is wording, and whether address and title ``mismatch`` the body."""
    some = [c for c in records.columns if c == "asked"]
    rows = records.select("rec_id", "host", "address", "title", "content", *some).where(F.col("content").isNotNull())
    rows = _with(rows, "low", F.lower(_spaced(F.col("content"))))
    rows = _with(rows, "tokens", _tokens(F.col("low")))
    # 0: nothing to see, 1: to be judged, 2: filler
    filler, hinted = _is_filler(F.col("low"), F.col("tokens")), _hinted(F.col("low"), F.col("tokens"))
    look = F.when(filler, 2).when(_contains_any(F.col("low"), _SLOT_MARKS) | hinted, 1).otherwise(0)
    if some:
        # of the others only the wording counts
        look = F.when(F.coalesce("asked", F.lit(False)), look).otherwise(F.when(hinted, F.when(filler, 2).otherwise(1)).otherwise(0))
    seen = _with(_with(rows, "look", look).where("look > 0"), "d", F.when(F.col("look") == 1, _judge(F.col("content"))))
    template = (F.col("d.slots") > 0) & (F.col("d.slot_rest") <= slot_words + words_per_slot * F.col("d.slots"))
    kind = F.when(F.col("look") == 2, "filler").when(template, "template").when(F.col("d.hint") & (F.col("d.hint_rest") <= rest_words), "error")
    # a title that only repeats the beginning of the body says nothing about it
    told = F.when(F.col("title").isNull() | F.col("content").startswith(F.col("title")), F.lit("")).otherwise(F.col("title"))
    mismatch = ~F.arrays_overlap(_terms(F.concat_ws(" ", "address", told)), _terms(F.col("content")))
    seen = seen.where((F.col("look") == 2) | template | F.col("d.hint"))
    return materialise(seen.select(F.monotonically_increasing_id().alias("row"), "rec_id", "host", kind.alias("kind"), F.coalesce(mismatch, F.lit(True)).alias("mismatch"), F.col("d.tokens").alias("tokens")), "residue")


def shared_wording(records: DataFrame, seen: DataFrame, hosts: int, share: float) -> DataFrame:
    """The pairs of neighbouring words (``gram``) that belong to responses: they came with such wording from at least ``hosts`` hosts, and at least ``share`` of all their occurrences in the corpus did."""
    there = _spread(seen.where("tokens IS NOT NULL"), "host").groupBy("gram", "host").agg(F.count("*").alias("n"))
    many = materialise(there.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("n_hosts")).where(F.col("n_hosts") >= hosts).select("gram", "n"), "wording")
    spread = _spread(records.where("content IS NOT NULL").select(_tokens(F.lower("content")).alias("tokens")))
    everywhere = spread.join(small(many.select("gram")), "gram").groupBy("gram").agg(F.count("*").alias("n_all"))
    return many.join(everywhere, "gram", "left").where(F.col("n") >= share * F.greatest(F.col("n"), F.coalesce("n_all", F.lit(0)))).select("gram")


def evidence(records: DataFrame, *, slot_words: float = 3.0, words_per_slot: float = 2.4, rest_words: float = 3.0, hosts: int = 3, share: float = 0.5) -> DataFrame:
    """Residue with what decided on it: ``rec_id``, ``kind`` and ``decided_by`` (``slots``, ``filler``, ``wording`` or ``corpus``); see ``residue``."""
    seen = _seen(records, slot_words, words_per_slot, rest_words)
    unclear = seen.where("kind IS NULL AND mismatch AND tokens IS NOT NULL")
    wording = materialise(shared_wording(records, seen, hosts, share), "shared")
    pairs = unclear.select("row", F.posexplode(_grams(F.col("tokens"))).alias("at", "gram")).join(small(wording), "gram")
    explained = pairs.select("row", F.explode(F.array("at", F.col("at") + 1)).alias("at")).distinct().groupBy("row").agg(F.collect_set("at").alias("explained"))
    left = F.array_distinct(F.filter("tokens", lambda token, i: ~F.array_contains("explained", i)))
    rest = F.aggregate(left, F.lit(0.0), lambda total, token: total + F.when(token.rlike(r"^[\x{4E00}-\x{9FFF}]$"), 0.5).otherwise(1.0))
    by_corpus = unclear.join(explained, "row").where(rest <= rest_words).select("rec_id", F.lit("error").alias("kind"), F.lit("corpus").alias("decided_by"))
    decided_by = F.when(F.col("kind") == "template", "slots").when(F.col("kind") == "filler", "filler").otherwise("wording")
    return seen.where("kind IS NOT NULL").select("rec_id", "kind", decided_by.alias("decided_by")).unionByName(by_corpus)


def residue(records: DataFrame, **thresholds) -> DataFrame:
    """Records whose content stands for missing real content.

    ``records`` needs ``rec_id``, ``host`` (who sent it), ``address`` (path or slug; null where there is none), ``title`` and
    ``content``; further columns are not read. Result: ``rec_id`` and ``kind`` (``template``, ``filler``, ``error``).

    * template: the words beside the slots are at most ``slot_words + words_per_slot`` times the slots;
    * filler: filler vocabulary, one short unit repeated (``LONGEST_UNIT``), or keyboard rows;
    * error (pages, notices, sample wording): such wording occurs and at most ``rest_words`` words remain beside it. Else the
      corpus decides: at most ``rest_words`` distinct words stand outside wording that such records share from at least
      ``hosts`` hosts and that has at least ``share`` of its occurrences in them; and no term of the address and title is in
      the body.

    With a column ``asked`` the result is complete only for the records where it is true: the others are read for the wording
    that they share, and for nothing else.

    Null, empty and blank content is never residue. Texts of any length are read whole, by the same tests. Repeated rows are
    judged one by one. An empty table gives an empty result.
    """
    return evidence(records, **thresholds).select("rec_id", "kind")


def exclude_residue(records: DataFrame) -> DataFrame:
    """All records but the residue, with their columns as they are. Needs unique ``rec_id``; see ``residue``."""
    gone = residue(records).select(F.col("rec_id").alias("__gone")).distinct()
    return records.join(gone, records["rec_id"] == gone["__gone"], "left_anti")


def message_records(messages: DataFrame) -> DataFrame:
    """Messages as records: the agent and client are the host, or the session where they are not given. Messages have no address or title that tells of their content."""
    told = F.concat_ws("/", F.get_json_object("metadata", "$.agent"), F.get_json_object("metadata", "$.client"))
    return messages.select(
        F.col("id").cast("string").alias("rec_id"),
        F.coalesce(F.nullif(told, F.lit("")), F.col("session_id"), F.lit("")).alias("host"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("title"),
        "content",
        *[c for c in messages.columns if c == "asked"],
    )


def candidate_records(candidates: DataFrame) -> DataFrame:
    """Review candidates as records: agent and source folder are the host, the file name is the address, the summary the title."""
    folder = F.regexp_extract(F.coalesce("source_path", F.lit("")), r"^(.*)/", 1)
    return candidates.select(
        F.col("id").alias("rec_id"),
        F.concat_ws("/", F.get_json_object("metadata", "$.agent"), folder).alias("host"),
        F.regexp_extract(F.coalesce("source_path", F.lit("")), r"([^/]*?)(?:\.[a-z]+)?$", 1).alias("address"),
        F.col("summary").alias("title"),
        "content",
    )


def together(tables: dict[str, DataFrame]) -> DataFrame:
    """The records of several tables as one corpus, ``rec_id`` headed by the table's name and a bar."""
    out = None
    for name, records in tables.items():
        one = records.withColumn("rec_id", F.concat(F.lit(f"{name}|"), "rec_id"))
        out = one if out is None else out.unionByName(one)
    return out


def by_table(found: DataFrame) -> DataFrame:
    """``found`` with ``tbl`` and the plain ``rec_id``; the inverse of ``together``. Rows without an id are left out."""
    return found.where("rec_id IS NOT NULL").withColumns({"tbl": F.expr("substring_index(rec_id, '|', 1)"), "rec_id": F.expr("substring(rec_id, instr(rec_id, '|') + 1)")})
