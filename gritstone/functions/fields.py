"""Names, identifiers, contact details, addresses and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import EMAIL

#: Fixed: words of a question that say nothing, and words that never tell a service.
STOPWORDS = "a an the i my me want need to get for how do can is of in on at apply new make please help".split()
NOT_EVIDENCE = "and or amp cum".split()
#: Fixed: words that a query can spare.
FILLER = "for of the and or in to a an on at by from with".split()
_DIGITS = "૦૧૨૩૪૫૬૭૮૯"


def intent_tokens(text: Column) -> Column:
    """Words of a question in lower case, marks and apostrophes kept, without single characters and stopwords."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}']+"), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def name_slug(text: Column) -> Column:
    """A name as an identifier: possessives and apostrophes go, everything else is one underscore, at most 60 characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"['‘’]s\b", ""), "['‘’]", "")
    return F.left(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(60))


def title(text: Column) -> Column:
    """Underscores as blanks, first letter large."""
    s = F.replace(text, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def display(text: Column) -> Column:
    """Each word with a capital, unless the text has a capital already."""
    words = F.transform(F.split(text, r"\b(?=[a-z])"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.when(text.rlike("[A-Z]"), text).otherwise(F.array_join(words, ""))


def readable(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), r"\s+", " "))


def shorten(name: Column, keep: int = 4) -> Column:
    """The first words of a name that aren't filler."""
    return F.array_join(F.slice(F.filter(F.split(readable(name), " "), lambda w: ~F.lower(w).isin(FILLER)), 1, keep), " ")


def humanise(field: Column) -> Column:
    """A field's name as a question."""
    bare = F.when(F.contains(field, F.lit(":")), F.get(F.split(field, ":"), F.lit(1))).otherwise(field)
    s = F.regexp_replace(F.regexp_replace(bare, "[_-]+", " "), "([a-z])([A-Z])", "$1 $2")
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)), F.lit("?"))


def sane(detail: Column) -> Column:
    """A map of details without null and empty ones, other scripts' digits as 0 to 9, 300 characters each."""
    kept = F.map_filter(detail, lambda _, v: v.isNotNull() & (v != ""))
    return F.transform_values(kept, lambda _, v: F.left(F.translate(v, _DIGITS, "0123456789"), F.lit(300)))


def phone(value: Column) -> Column:
    """A printed number of 10 to 15 digits as it is printed, blanks single, 40 characters; else null."""
    s = F.trim(value)
    n = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return F.when(~s.rlike(r"(?i)^(n\.?a\.?|nil|none|-+)$") & n.between(10, 15), F.left(F.regexp_replace(s, r"\s+", " "), F.lit(40)))


def phone_e164(raw: Column) -> Column:
    """A number with its country, +91 where none is told; else null."""
    d = F.regexp_replace(raw, "[^0-9]", "")
    abroad = lambda x: F.when(F.length(x).between(8, 15), F.concat(F.lit("+"), x))
    n = F.length(d)
    return (
        F.when(F.trim(raw).startswith("+"), abroad(d)).when(d.startswith("00"), abroad(F.substr(d, F.lit(3)))).when((n == 12) & d.startswith("91"), F.concat(F.lit("+"), d))
        .when((n == 11) & d.startswith("0"), F.concat(F.lit("+91"), F.substr(d, F.lit(2)))).when(n == 10, F.concat(F.lit("+91"), d))
    )


def email(value: Column) -> Column:
    s = F.lower(F.trim(value))
    return F.when(s.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), s)


def address(value: Column) -> Column:
    """White space single; null under 20 and over 300 characters."""
    s = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(s).between(20, 300), s)


def pincode(text: Column) -> Column:
    """The first six digits that no digit touches; null without any."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{6})(?!\d)", 1), F.lit(""))


#: Fixed: parts of an address that are never a place.
NOISE = r"""(?i)^(office of|o/o)\b|\b(floor|flr|block|wing|room|cabin|campus|building)\b|^(near|nr\.?|opp\.?|opposite|behind|beside|b/h|above|below)\b|^["'‘’]?[\p{L}0-9-]{1,3}["'‘’]?$|^\d+(st|nd|rd|th)?\b"""


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def geocode_queries(text: Column, around: Column, limit: int = 3) -> Column:
    """What to ask a gazetteer: the whole address, then up to `limit` of its parts that may be places, each with the names in `around` and the whole one with its pincode, no name twice."""
    bare = F.regexp_replace(text, r"[-–—]?\s*\b\d{6}\b\.?\s*$", "")
    parts = F.filter(F.transform(F.split(bare, r"\s*[,\n]\s*"), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s{2,}", " "), r"^[.,\s]+|[.,\s]+$", "")), lambda p: p != "")

    def context(names: Column) -> Column:
        told = F.filter(names, lambda p: p.isNotNull() & (p != ""))
        first = F.get(F.transform(F.array(told), lambda held: F.filter(held, lambda p, i: F.array_position(F.transform(held, _plain), _plain(p)) == i + 1)), F.lit(0))
        return F.array_join(first, ", ")

    known = F.transform(around, _plain)
    places = F.filter(parts, lambda p: ~p.rlike(NOISE) & (F.length(_plain(p)) >= 4) & ~F.array_contains(known, _plain(p)) & ~_plain(p).rlike(r"^\d+$"))
    back = F.transform(F.slice(places, 1, limit), lambda p: context(F.concat(F.array(p), around)))
    return F.array_distinct(F.concat(F.array(context(F.concat(parts, around, F.array(pincode(text))))), back))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the characters, eight hex digits. Characters past U+FFFF would count as two in languages of 16-bit units and count as one here."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(4294967295).cast("bigint"))
    told = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), step)
    return F.lpad(F.lower(F.hex(told)), 8, "0")


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed digest in hex; the key becomes part of the plan, so pass one that may be seen there."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def crow_km(km: Column) -> Column:
    """A distance as the crow flies: tilde, metres by the hundred under one km, a decimal under ten."""
    return F.when(km < 1, F.concat(F.lit("~"), (F.round(km * 10) * 100).cast("int"), F.lit(" m"))).otherwise(F.concat(F.lit("~"), routed_km(km)))


def routed_km(km: Column) -> Column:
    return F.concat(F.when(km < 10, F.format_string("%.1f", km)).otherwise(F.round(km).cast("int").cast("string")), F.lit(" km"))


def duration(seconds: Column) -> Column:
    minutes = F.round(seconds / 60).cast("int")
    return F.when(minutes < 60, F.concat(minutes, F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60), F.lit(" hr "), minutes % 60, F.lit(" min")))


def latin_script(text: Column) -> Column:
    return ~text.rlike(r"[\x{0900}-\x{0DFF}]")


#: What is masked, in order: e-mail addresses, keys, tax numbers, 12-digit numbers, 10-digit mobiles, one-time codes.
SECRETS = (
    (EMAIL, "[email]"), (r"\bsk-[A-Za-z0-9_-]{8,}", "[key]"), (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[pan]"), (r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[id]"),
    (r"\b[6-9][0-9]{9}\b", "[phone]"), (r"(?i)\b(otp|code|pin)([ :is]{1,4})[0-9]{4,6}\b", "$1$2[code]"),
)


def redacted(text: Column) -> Column:
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


#: Words for setting rules aside and for rules, for telling and for what isn't told, and for other people; English, Hindi and Gujarati, the latter two in Latin letters too.
_FORGET = r"\b(ignore|forget|disregard|bypass|override|skip|bhool|bhul|bhuli|chhodo|andekha)\b|भूल|अनदेखा|नज़रअंदाज़|ભૂલી|અવગણ"
_RULES = r"\b(instructions?|rules|guidelines|guardrails?|restrictions?|system prompt|niyam|nirdesh)\b|निर्देश|नियम|સૂચના|નિયમ"
_TELL = r"\b(tell|show|reveal|print|give|leak|dump|repeat|output|batao|bata|dikhao|batavo|aapo)\b|बताओ|बताइए|दिखाओ|दो|બતાવો|જણાવો|આપો"
_SECRET = r"\b(system prompt|hidden prompt|your prompt|api ?keys?|secret keys?|access tokens?|environment variables?|env vars?|your instructions)\b|सिस्टम प्रॉम्प्ट|सिस्टम प्रॉम्प्ट|एपीआई की|સિસ્ટમ પ્રોમ્પ્ટ|એપીઆઈ કી"
_OTHERS = r"\b(previous|last|other|another|earlier) (caller|user|citizen|person|customer)('s)?\b|\b(pichle|pichhle|dusre|agla) (caller|user|aadmi)\b|पिछले कॉलर|दूसरे (कॉलर|व्यक्ति|यूज़र)|અગાઉના કૉલર|બીજા (કૉલર|વપરાશકર્તા)"
_QUERY = r"\bselect\b.{1,60}\bfrom\b.{0,20}\b[a-z]+_[a-z]+|\b(drop|truncate|alter) table\b|\b(run|execute) (this |the )?(sql|query|command|code)\b|\bunion select\b"
_NEAR = r"[^.!?\n]{0,60}"


def _together(a: str, b: str) -> str:
    """Two kinds of words in one clause, in either order: a verb stands after its object in half of these languages."""
    return f"({a}){_NEAR}({b})|({b}){_NEAR}({a})"


#: Patterns of inputs that try to take over, and of those that are only odd.
REFUSED = f"(?i){_together(_FORGET, _RULES)}|{_together(_TELL, _SECRET)}|{_OTHERS}|{_QUERY}|\\byou are now\\b|\\bjailbreak\\b"
FLAGGED = r"(?i)\bpretend\b|\bact as\b|developer mode|<\|[a-z_]+\|>|base64|\bi am (the |an? )?(admin|administrator|developer|owner)\b|\bunlock everything\b|\b(increase|raise|remove) my\b.{0,20}\blimit|environment variables?|system prompt"


def verdict(text: Column) -> Column:
    """REFUSE, FLAG or ALLOW for what a caller typed."""
    return F.when(text.rlike(REFUSED), "REFUSE").when(text.rlike(FLAGGED), "FLAG").otherwise("ALLOW")


def common_prefix(quote: Column, page: Column) -> Column:
    """Length of the longest beginning of a quote that stands somewhere in the page, found by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        there = F.contains(page, F.left(quote, middle))
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(there, middle).otherwise(s["lo"]).alias("lo"), F.when(there, s["hi"]).otherwise(middle - 1).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.length(quote).cast("int").alias("hi"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.length(quote) + 2)).cast("int") + 1)
    return F.aggregate(steps, start, halve, lambda s: s["lo"])
