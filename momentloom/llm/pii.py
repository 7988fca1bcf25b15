"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Each entity found gets one stand-in everywhere, made from a keyed hash of its canonical form and
shaped like it: an e-mail stays an address of the same lengths, a card keeps its first digit and
a valid check digit, a name keeps gender, script and case. Two entities never share a stand-in,
and none is another entity of the corpus: clashes are found and drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from momentloom.session import stage

_TITLE_M = "Mr|Herr|Monsieur|Señor|Sr|Г-н"
_TITLE_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа"
_TITLE = f"{_TITLE_M}|{_TITLE_F}"
_NAME = r"\p{Lu}[\p{L}'’\-]++"
_STOP = r"(?![\p{L}\p{N}_])"
_SECRETS = tuple(form(w) for w in ("token", "secret", "password", "passwort", "passwd", "api_key", "api-key", "apikey")
                 for form in (str.lower, str.upper, str.capitalize))

#: Patterns of the kinds, in the order they are tried; all begin where no word goes on. Secrets,
#: hexadecimal numbers and names run on as far as their characters do; only a given name before a
#: family name must be of 101 letters at most, as Java's look-behind needs a bound.
KINDS = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": rf"(?<=(?:{'|'.join(_SECRETS)}) {{0,2}}[=:] {{0,2}}[\"']?)[\p{{L}}\p{{N}}_+/\-]{{8,}}+",
    "access_key": rf"AKIA[0-9A-Z]{{16}}{_STOP}",
    "hex": rf"[0-9a-fA-F]{{32,}}+{_STOP}",
    "phone": r"(?=[+(\d])(?<!\+)(?:(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}"
             r"|\+\d{1,3}[ .\-]\d{2,4}[ .\-]\d{3,4}[ .\-]\d{3,4}|\d{3}[.\-]\d{3}[.\-]\d{4})" + _STOP,
    "ip": r"(?=\d)(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}_]|\.\d)",
    "card": r"(?=[2-6])(?<![.\-])[2-6](?:[ \-]?\d){12,18}" + _STOP,
    "ssn": r"(?=\d)(?<![.\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_\-])",
    "name": rf"(?=\p{{Lu}})(?<= )(?<=(?<![\p{{L}}\p{{N}}_])(?:{_TITLE})\.? (?:\p{{Lu}}[\p{{L}}'’\-]{{1,100}} )?){_NAME}",
}
ALL = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(KINDS.values())})"
#: Every text with an entity has a digit, an @, 32 letters a-f, or one of these; most have none.
HINTS = (*_SECRETS, *_TITLE.split("|"), "AKIA")
NAMES = ("given_m", "given_f", "family")
#: Draws in an entity's own shape; each later one may be a character longer, so that also shapes
#: of which the corpus holds most get stand-ins. The last draws have far more room than any corpus.
SHAPED, ROUNDS = 8, 30

# Syllables and endings of made-up names.
_SYLLABLES = ("ba be do fa ga ka la li lo ma mi na no pa ra ri ro sa ta va ve vi".split(),
              "ба ве до фа га ка ла ли ло ма ми на но па ра ри ро са та ва ве ви".split())
_ENDINGS = {"given_m": ("rek don mir tan".split(), "рек дон мир тан".split()),
            "given_f": ("lia nna ssa rina".split(), "лия нна сса рина".split()),
            "family": ("son man ford well".split(), "нов кин ский ев".split())}


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))  # in one pass: an entity may be long


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum of the card check; a multiple of ten if the number is valid."""
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    weighted = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def _kind(i: Column) -> Column:
    """Kind of entity i of ``_raw`` by its form and what stands before it in ``seps``; null for a
    number that fails the card check."""
    raw, before = F.get("_raw", i), F.get("seps", i)
    titled = before.rlike(rf"(?:{_TITLE})\.? $")
    more = (F.get("seps", i + 1) == " ") & F.coalesce(F.get("_raw", i + 1), F.lit("")).rlike(rf"^{_NAME}$")
    given = F.when(before.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{_TITLE_F})\.? $"), "given_f").otherwise("given_m")
    secret = before.rlike(rf"(?:{'|'.join(_SECRETS)}) {{0,2}}[=:] {{0,2}}[\"']?$")
    is_hex = raw.rlike("^[0-9a-fA-F]{8,}$")
    return (F.when(raw.contains("@"), "email").when(secret & is_hex, "hex").when(secret & ~raw.startswith("AKIA"), "key")
            .when(raw.rlike("^AKIA[0-9A-Z]{16}$"), "access_key").when(raw.rlike("^[0-9a-fA-F]{32,}$"), "hex")
            .when(raw.rlike(r"^\d+(?:\.\d+){3}$"), "ip").when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(raw.rlike(r"^[2-6](?:[ \-]?\d){12,18}$"), F.when(luhn_sum(_digits(raw)) % 10 == 0, "card"))
            .when(raw.rlike(r"^[+(\d]"), "phone").when(titled & more, given).otherwise("family"))


def _canon(raw: Column, kind: Column) -> Column:
    """What all spellings of an entity share: country code and digits, or lower case."""
    code = F.regexp_extract(raw, r"^\+(\d{1,3})(?=[ .(\-])", 1)
    return (F.when(kind == "card", _digits(raw))
            .when(kind == "phone", F.concat(code, F.lit(":"), F.substring(_digits(raw), F.char_length(code) + 1, F.lit(99))))
            .otherwise(F.lower(raw)))


def _draw(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Keyed hash of an entity as blocks of 32 bytes in hexadecimal, as many as its shape needs."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    return F.transform(F.sequence(F.lit(1), F.ceil(F.char_length(canon) / 32).cast("int") + 1),
                       lambda b: F.sha2(F.concat_ws("|", F.lit(key), seed, b.cast("string")), 256))


def _byte(draw: Column, i: Column) -> Column:
    return F.conv(F.substring(F.get(draw, F.shiftright(i, 5)), i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), n % len(values))


def surrogate(kind: Column, canon: Column, attempt: Column, draw: Column) -> Column:
    """Canonical form of the stand-in that ``draw`` gives for an entity.

    After ``SHAPED`` draws it grows by a character each: in front of an address, before a card's
    check digit, else at the end. An IP takes octets of any length, and after as many draws again
    further octets; names have a syllable more from draw to draw.
    """
    alphabets = [("0-9", "0123456789"), ("a-z", "abcdefghijklmnopqrstuvwxyz"), ("а-я", "абвгдежзиклмнопрстуфхцчшэюя"), ("α-ω", "αβγδεζηθικλμνξοπρστυφχψω")]

    def letter(c: Column, i: Column) -> Column:
        n = _byte(draw, i)
        out = F.when((kind == "hex") & c.rlike("[a-f]"), _pick(list("abcdef"), n))
        for span, alphabet in alphabets:
            out = out.when(c.rlike(f"[{span}]"), _pick(list(alphabet), n))
        return out.when(c.rlike(r"\p{L}"), _pick(list(alphabets[1][1]), n)).when(c.rlike(r"\p{N}"), _pick(list("0123456789"), n)).otherwise(c)

    # The part that stays: country code, first digit, prefix of a key; and an address's last label.
    keep = (F.when(kind == "phone", F.instr(canon, ":")).when(kind == "card", F.lit(1)).when(kind == "access_key", F.lit(4)).otherwise(F.lit(0)))
    stay = F.when(kind == "email", F.char_length(canon) - F.char_length(F.substring_index(canon, ".", -1))).otherwise(F.char_length(canon))
    spelled = F.array_join(F.transform(_chars(canon), lambda c, i: F.when((i < keep) | (i >= stay), c).otherwise(letter(c, i))), "")
    longer = lambda values: F.when(attempt > SHAPED, F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(attempt - SHAPED, F.lit(1))), lambda k: _pick(list(values), _byte(draw, F.char_length(canon) + k))), "")).otherwise("")
    more = F.when(kind.isin("phone", "card", "ssn"), longer("0123456789")).when(kind == "hex", longer("0123456789abcdef")).otherwise(longer(alphabets[1][1]))
    body = F.concat(F.substring(spelled, F.lit(1), F.char_length(spelled) - 1), more)
    card = F.concat(body, ((F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    octet = lambda o, i: (F.when(F.char_length(o) == 1, 1 + _byte(draw, i) % 9).when(F.char_length(o) == 2, 10 + _byte(draw, i) % 90)
                          .otherwise(100 + _byte(draw, i) % 155)).cast("string")
    octets = F.when(attempt > SHAPED, F.transform(F.sequence(F.lit(0), F.lit(3) + F.greatest(attempt - 2 * SHAPED, F.lit(0))), lambda i: _byte(draw, i).cast("string")))
    ip = F.array_join(octets.otherwise(F.transform(F.split(canon, r"\."), octet)), ".")
    cyrillic = canon.rlike(r"\p{IsCyrillic}")

    def name(of: str, script: int) -> Column:
        syllables = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), lambda k: _pick(_SYLLABLES[script], _byte(draw, k % 30))), "")
        return F.concat(syllables, _pick(_ENDINGS[of][script], _byte(draw, F.lit(0))))

    out = F.when(kind == "card", card).when(kind == "ip", ip)
    for of in NAMES:
        out = out.when((kind == of) & cyrillic, name(of, 1)).when(kind == of, name(of, 0))
    return out.when(kind == "email", F.concat(more, spelled)).otherwise(F.concat(spelled, more))


def _spell(raw: Column, kind: Column, stand_in: Column) -> Column:
    """The stand-in as this occurrence writes it: its case, spaces and punctuation."""
    digits = F.replace(stand_in, F.lit(":"), F.lit(""))
    numbers = F.array_join(F.transform(_chars(raw), lambda c, i: F.when(c.rlike(r"\d"), F.substring(
        digits, F.char_length(_digits(F.substring(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substring(digits, F.char_length(_digits(raw)) + 1, F.char_length(digits)))
    cased = F.array_join(F.zip_with(_chars(stand_in), _chars(raw), lambda c, r: F.when(r.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    name = F.when(raw.rlike(r"^\P{Ll}+$") & (F.char_length(raw) > 1), F.upper(stand_in)).otherwise(F.initcap(stand_in))
    return (F.when(stand_in.isNull(), raw).when(kind.isin("phone", "card"), numbers).when(kind.isin(*NAMES), name).otherwise(cased))


def find_entities(texts: DataFrame) -> DataFrame:
    """Per row of ``texts`` (key, text): key, seps, found, the pieces around the entities, and
    per entity raw, kind (null: looks like one, but is left) and canon."""
    rows = texts.select("key", F.split("text", ALL).alias("seps"), F.regexp_extract_all("text", F.lit(ALL), F.lit(0)).alias("_raw"))
    rows = rows.select("key", "seps", F.transform("_raw", lambda raw, i: F.struct(raw.alias("raw"), _kind(i).alias("kind"))).alias("_f"))
    return rows.select("key", "seps", F.transform("_f", lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), _canon(x["raw"], x["kind"]).alias("canon"))).alias("found"))


def may_have_entities(text: Column) -> Column:
    """True for every text with an entity, found by searches far cheaper than the patterns."""
    some = text.rlike("[0-9@]|[a-fA-F]{32}")
    for hint in HINTS:
        some = some | text.contains(hint)
    return F.coalesce(some, F.lit(False))


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, stand_in for distinct (kind, canon): one-to-one within a kind, and no
    stand-in is an entity of the corpus.

    Each round looks for stand-ins drawn by two entities or owned by one; the entity that drew
    first keeps it, the others draw again. Rounds are staged tables of entities, not of text.
    """
    owned = entities.select("kind", F.col("canon").alias("stand_in")).withColumn("_owned", F.lit(True))
    table = entities.select("kind", "canon", F.lit(0).alias("attempt"))
    for _ in range(ROUNDS):
        drawn = table.withColumn("_draw", _draw(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        drawn = drawn.select("kind", "canon", "attempt", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("_draw")).alias("stand_in"))
        place = F.row_number().over(W.partitionBy("kind", "stand_in").orderBy("attempt", "canon"))
        checked = stage(drawn.withColumn("_place", place).join(owned, ["kind", "stand_in"], "left")
                        .select("kind", "canon", "attempt", "stand_in", ((F.col("_place") > 1) | F.coalesce("_owned", F.lit(False))).alias("_clash")), "surrogates")
        if checked.filter("_clash").isEmpty():
            return checked.select("kind", "canon", "stand_in")
        table = checked.select("kind", "canon", (F.col("attempt") + F.col("_clash").cast("int")).alias("attempt"))
    raise ValueError(f"stand-ins still clash after {ROUNDS} draws")


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and n_entities (replaced in that text).

    A text without entities, null and empty ones included, stays as it is; so do all other
    columns (one named n_entities is replaced). Equal texts change equally. Numbers that fail the
    card check are left. Only texts that may have entities are shuffled, once per distinct
    text; the others stay where they are. The same ``key`` gives the same stand-ins for the same corpus.
    """
    kept = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    has = may_have_entities(F.col(f"`{text}`"))
    told = docs.filter(has)
    hashed = F.sha2(F.col(f"`{text}`").cast("binary"), 256)
    texts = told.select(hashed.alias("key"), F.col(f"`{text}`").alias("text")).dropDuplicates(["key"])
    found = stage(find_entities(texts), "entities")
    entities = stage(found.select(F.inline("found")).filter("kind IS NOT NULL").select("kind", "canon").distinct(), "entity-list")
    stand_ins = assign_surrogates(entities, key)
    # One row per piece of text and the entity after it; the last piece has none.
    pieces = found.select("key", F.posexplode(F.transform("seps", lambda s, i: F.struct(s.alias("sep"), F.get("found", i).alias("e")))).alias("at", "p"))
    pieces = pieces.select("key", "at", "p.sep", "p.e.raw", "p.e.kind", "p.e.canon").join(stand_ins, ["kind", "canon"], "left")
    written = pieces.select("key", F.struct("at", F.concat("sep", F.when(F.col("raw").isNull(), "").otherwise(_spell(F.col("raw"), F.col("kind"), F.col("stand_in")))).alias("t"),
                                            F.col("stand_in").isNotNull().cast("bigint").alias("n")).alias("p"))
    new = written.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sum("p.n").alias("n_entities"))
    new = new.select(F.col("key").alias("_key"), F.array_join(F.col("ps.t"), "").alias("_text"), "n_entities")
    changed = told.withColumn("_key", hashed).join(new, "_key").select(
        *[F.col("_text").alias(c) if c == text else F.col(f"`{c}`") for c in kept], "n_entities")
    return docs.filter(~has).withColumn("n_entities", F.lit(0).cast("bigint")).unionByName(changed)
