"""What a sentence of a page names: the office to go to, the authority that signs, the thing handed out, its step, its stage.

A grammar is an ordered list of (label, pattern) rules. All rules are Column expressions: the first
that matches gives the phrase, guards then keep or refuse it, and tails are cut in a stated order.
A refusal isn't a lack: `refused` tells sentences that a rule reads but a guard rejects.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# The patterns of sentences, words and tails.
_LOCATED = r"(?i)^(?:the\s+)?(.{4,90}?)\s+(?:is|are)\s+(?:located|situated|based)\s+(?:at|in)\b|^(?:the\s+)?(.{4,90}?)(?:'s)?\s+(?:office\s+)?address\s+is\b|^(?:the\s+)?(.{4,90}?)\s+is\s+at\b"
_SUBMIT = r"(?i)\b(?:submitted|submit|apply|applied|obtained|available|contact)\s+(?:at|to|from)\s+(?:the\s+)?([^.,;()]{4,80})"
PLACE_WORD = (
    r"(?i)\b(department|directorate|commission|commissioner|commissionerate|corporation|board|office|kendra|kacheri|bhavan|bhawan|sadan|sachivalaya|collector|mamlatdar|rto|council|authority|agency|campus|"
    r"institute|centre|center|magistrate|municipal|panchayat|nagarpalika|taluka|headquarters|prant)\b|કચેરી|ભવન|કેન્દ્ર"
)
_OFFICE_TAILS = (
    (r"(?i)\s+at\s+(?:block|plot|room|floor|near|opp\b|\d).*$", ""),
    (r"(?i)^(?:main|head|administrative|registration|regional|central|corporate)\s+office\s+(?:of|for)\s+(?:the\s+)?", ""),
    (r"(?i)^(?:contact\s+information|address)\s+(?:for|of)\s+(?:the\s+)?", ""),
    (r"(?i)'s\s+(?:head|main|administrative)?\s*office$", ""),
)
_BE = r"(?i)\b(?:is|are|was|were|will\s+be|shall\s+be)\s+"
_BODY = r"\s+by\s+(?:the\s+)?([^.,;()]{4,70})"
PASSIVE = (
    ("ISSUED_BY", rf"{_BE}(?:issued|granted){_BODY}"),
    ("ISSUED_BY", r"(?i)\bmust\s+be\s+obtained\s+from\s+(?:the\s+)?([^.,;()]{4,70})"),
    ("VERIFIED_BY", rf"{_BE}(?:verified|attested|countersigned|approved|sanctioned){_BODY}"),
    ("VERIFIED_BY", rf"(?i)\bverification{_BODY}"),
)
ACTIVE = (
    ("ISSUED_BY", r"(?i)^(?:the\s+)?([^.,;()]{4,70})\s+(?:issues|grants)\s+\S"),
    ("VERIFIED_BY", r"(?i)^(?:the\s+)?([^.,;()]{4,70})\s+(?:approves|verifies|inspects)\s+\S"),
)
UNNAMED = r"(?i)^(?:(?:an?|any|the)\s+)?(?:prescribed|concerned|appropriate|competent|respective|relevant|designated|authorised|authorized|issuing|licensing|sanctioning|approval|nodal|above|said)\b"
OFFICER_WORD = r"(?i)\b(officer|adhikari|inspector|registrar|tahsildar|talati|ministry|secretary|university|institute|committee)\b"
_CONDITION_TAIL = r"(?i)\s+(?:if|when|upon|as\s+per|as|under|within|after|before|for|on|in\s+case)\b.*$"
SEVERAL = r"(?i)\b(?:any|either|one|two|three)\s+(?:of|the|three|two)\b|/|\sand\s+then\s|\s+or\s+"
OUTPUT = (
    ("OUTPUT", r"(?i)\b(?:applicant|citizen|user|beneficiary|candidate|holder)\s+(?:will\s+)?(?:receives?|shall\s+receive|will\s+receive|gets?|obtains?|is\s+issued|is\s+granted)\s+(?:an?\s+|the\s+)?([^.,;()]{4,60})"),
    ("OUTPUT", r"(?i)\b(?:an?\s+|the\s+)?([^.,;()]{4,60}?)\s+(?:will\s+be|shall\s+be|is|are)\s+(?:issued|granted|provided|generated)\s+(?:to\s+the\s+applicant|online|by\s+the|after|on\s+completion|upon)"),
    ("OUTPUT", r"(?i)\bon\s+(?:successful\s+)?(?:completion|approval|registration)[^.]{0,40}?,?\s*(?:an?\s+|the\s+)?([^.,;()]{4,60}?)\s+(?:will\s+be|shall\s+be|is)\s+(?:issued|generated|granted)"),
)
OUTPUT_NOUN = (
    r"(?i)\b(certificate|licence|license|permit|card|number|registration|letter|passbook|sanction|approval|slip|receipt|challan|declaration|identity|id|patta|khata|passport|policy|award|order|memo|"
    r"acknowledgment|acknowledgement|token)\b"
)
NO_OUTPUT = r"(?i)\b(?:process|procedure|service|scheme|application|form|website|portal|information|details|status|assistance|benefit|amount|subsidy|instalment|installment|payment|fund|training|facility)\b"
_OUTPUT_TAILS = (
    (_CONDITION_TAIL, ""),
    (r"(?i)\s+(?:and|or|which|who|that|valid|containing|along|from|issued|granted|provided|generated|through|via|by|at|online|offline|digitally|once|only|instantly|immediately|directly)\b.*$", ""),
    (r"(?i)^(?:his|her|their|its|your)\s+", ""),
    (r"""^['"‘’“”]+|['"‘’“”]+$""", ""),
)
HONORIFIC = r"(?i)^\s*(dr|shri|shree|smt|shrimati|mr|mrs|ms|prof|sri|kum|thiru)\b\.?\s|^\s*(હો?ન|શ્રી|શ્રીમતી|ડૉ|ડો)\.?\s"
CADRE = r"(?i)[,(]\s*(i\.?a\.?s|i\.?p\.?s|i\.?f\.?s|g\.?a\.?s|g\.?p\.?s|r\.?a\.?s)\.?\s*[).]?\s*$"
#: Words, in lower case, one of which stands in whatever a pattern matches; looked for first, since most sentences have none and a search for a word is cheap.
_MUST = {
    **dict(zip((p for _, p in PASSIVE), (("issued", "granted"), ("obtained",), ("verified", "attested", "countersigned", "approved", "sanctioned"), ("verification",)))),
    **dict(zip((p for _, p in ACTIVE), (("issues", "grants"), ("approves", "verifies", "inspects")))),
    **dict(zip((p for _, p in OUTPUT), (("applicant", "citizen", "user", "beneficiary", "candidate", "holder"), ("issued", "granted", "provided", "generated"), ("issued", "generated", "granted")))),
}
#: Stages in the order in which an applicant meets them; stages of dimensions; verbs that tell the stage otherwise.
STAGES = ("ELIGIBILITY", "PREPARE", "APPLY", "IN_PERSON", "AFTER_SUBMISSION", "TRACK", "HELP")
STAGE_OF = {"ELIGIBILITY": "ELIGIBILITY", "DOCUMENTS": "PREPARE", "OFFICE": "IN_PERSON", "TRACKING": "TRACK", "HELPLINE": "HELP", "ESCALATION": "HELP", "OUTPUT": "AFTER_SUBMISSION"}
STAGE_VERBS = (
    ("IN_PERSON", r"(?i)\b(visit|go to|appear|attend|present yourself|in person|at the (?:office|counter)|bring (?:the )?original)\b"),
    ("TRACK", r"(?i)\b(track|status of|check the status|know your (?:application|status)|to (?:get|view|see) [\w' ]{0,30}details)\b"),
    ("AFTER_SUBMISSION", r"(?i)\b(will be (?:issued|given|generated|sent|delivered)|after (?:registration|submission|completion|approval)|collect the|download the (?:certificate|licence|license))\b"),
    ("PREPARE", r"(?i)\b(keep ready|gather|obtain|attach|upload|scan|self.?attest)\b"),
)
_MICRO = r"(?i)^\s*(?:click|press|tap|select|choose|scroll|hover)\b"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; before a last line terminator of those beyond ASCII too, as $ has it."""
    odd = lambda t: reduce(lambda a, b: a | b, (t.endswith(c) for c in "\x85\u2028\u2029"))
    return let(text, lambda t: F.when(odd(t), F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.btrim(t, F.lit(" \t\n\x0b\f\r"))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _reads(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern of _MUST is in a text; `low` is the text in lower case."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in _MUST[pattern])) & text.rlike(pattern)


def _phrase(text: Column, pattern: str, groups: int = 1) -> Column:
    """The first of a pattern's groups that took part; null where the pattern isn't in the text."""
    return F.when(text.rlike(pattern), F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, k + 1), F.lit("")) for k in range(groups)), F.lit("")))


def _cut(phrase: Column, tails: tuple[tuple[str, str], ...]) -> Column:
    bare = reduce(lambda p, t: F.regexp_replace(p, *t), tails, phrase)
    return stripped(F.regexp_replace(bare, r"\s{2,}", " "))


def is_person(name: Column) -> Column:
    """Whether a name has a title before it or a service's letters after it."""
    return name.rlike(HONORIFIC) | name.rlike(CADRE)


def office_of(claim: Column) -> Column:
    """The office that a sentence places or sends people to; null where it has no word for a place."""
    raw = let(stripped(claim), lambda text: stripped(F.coalesce(_phrase(text, _LOCATED, 3), _phrase(text, _SUBMIT))))
    both = F.struct(raw.alias("raw"))
    return let(both, lambda x: F.when(x["raw"].rlike(PLACE_WORD), let(_cut(x["raw"], _OFFICE_TAILS), lambda name: F.when(F.length(name) > 3, name))))


def authority_of(claim: Column, active: Column) -> Column:
    """struct(type, authority) of the one body that a sentence names in the passive, or in the active where `active` is true (for claims that were looked up for the service).

    The first rule that matches decides: a phrase of several bodies, or one without a name, is refused and later rules don't get a turn.
    """
    return authority_read(claim, active)["told"]


def authority_refused(claim: Column, active: Column) -> Column:
    """Whether a sentence has an authority's verb, but none that may be named."""
    return let(authority_read(claim, active), refused)


def refused(read: Column) -> Column:
    """Whether a sentence, as authority_read and output_read tell it, is read by a rule but names nothing that passes the guards."""
    return F.coalesce(read["read"] & read["told"].isNull(), F.lit(False))


def authority_read(claim: Column, active: Column) -> Column:
    """struct(read, told): whether a rule reads the sentence, and what passes the guards; for callers that need both of a sentence that is read once."""
    allowed = [(F.lit(True), r) for r in PASSIVE] + [(active, r) for r in ACTIVE]

    def first(text: Column) -> Column:
        return let(F.lower(text), lambda low: F.coalesce(*(F.when(ok & _reads(text, low, p), F.struct(F.lit(kind).alias("type"), stripped(F.regexp_extract(text, p, 1)).alias("raw"))) for ok, (kind, p) in allowed)))

    def guarded(m: Column) -> Column:
        one = ~m["raw"].rlike(SEVERAL) & ~m["raw"].rlike(UNNAMED)
        name = F.when(one, _cut(m["raw"], ((_CONDITION_TAIL, ""),)))
        good = lambda n: (F.length(n) >= 4) & ~is_person(n) & (n.rlike(PLACE_WORD) | n.rlike(OFFICER_WORD))
        return F.struct(m.isNotNull().alias("read"), let(name, lambda n: F.when(good(n), F.struct(m["type"].alias("type"), n.alias("authority")))).alias("told"))

    return let(let(stripped(claim), first), guarded)


def output_of(claim: Column) -> Column:
    """What the applicant is handed, by the first rule whose phrase passes all guards; a guarded phrase leaves the turn to the next rule."""
    return output_read(claim)["told"]


def output_refused(claim: Column) -> Column:
    return let(output_read(claim), refused)


def output_read(claim: Column) -> Column:
    """struct(read, told) as of authority_read, for what is handed out."""

    def named(raw: Column) -> Column:
        name = F.when(~raw.rlike(SEVERAL), _cut(raw, _OUTPUT_TAILS))
        return let(name, lambda n: F.when((F.length(n) >= 4) & ~is_person(n) & n.rlike(OUTPUT_NOUN) & ~n.rlike(NO_OUTPUT), n))

    def phrases(text: Column) -> Column:
        return let(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(_reads(text, low, p), stripped(F.regexp_extract(text, p, 1))) for _, p in OUTPUT))))

    told = lambda raws: F.get(F.array_compact(F.transform(raws, named)), F.lit(0))
    return let(let(stripped(claim), phrases), lambda raws: F.struct((F.size(raws) > 0).alias("read"), told(raws).alias("told")))


def office_name(detail: Column, object_: Column, claim: Column, fields: list[str]) -> Column:
    """What to call a fact's office: a printed name that is no person's, else its object unless that names a form field, else what its sentence says."""
    keys = ("officeName", "office_name", "name", "institute_name", "institute")
    told = F.coalesce(*(F.nullif(F.try_element_at(detail, F.lit(k)), F.lit("")) for k in keys))
    field = F.length(object_).isNull() | (F.length(object_) < 5) | object_.isin(fields) | object_.rlike(r"^(office_)?(address|email|contact|phone|number|no|url|website|location|hours)$|_(address|email|no|number|url)$")
    return F.when((F.length(stripped(told)) > 3) & ~is_person(told), stripped(told)).when(~field, object_).otherwise(office_of(claim))


def stage_of(dimension: Column, claim: Column) -> Column:
    """The stage of a dimension, else of the first kind of verb in the sentence, else APPLY."""
    known = reduce(lambda w, kv: w.when(dimension == kv[0], kv[1]), list(STAGE_OF.items())[1:], F.when(dimension == "ELIGIBILITY", "ELIGIBILITY"))
    verb = F.coalesce(*(F.when(claim.rlike(p), stage) for stage, p in STAGE_VERBS), F.lit("APPLY"))
    return F.coalesce(known, verb)


def is_micro(claim: Column) -> Column:
    """Whether a sentence only tells to work a control."""
    return F.coalesce(claim.rlike(_MICRO), F.lit(False))


def source_type(url: Column, title: Column, kinds: Column) -> Column:
    """Of what sort a page is, by its path and title, else by a kind that more than 0.6 of its facts have. `kinds` is an array of fact kinds."""
    path = F.lower(F.regexp_replace(url, r"(?i)^https?://[^/]+", ""))
    text = F.concat(path, F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    only = lambda k: F.coalesce(F.size(F.filter(kinds, lambda x: x == k)) > 0.6 * F.greatest(F.size(kinds), F.lit(0)), F.lit(False)) & (F.size(kinds) > 0)
    return (
        F.when(path.rlike(r"\.pdf$"), "PDF").when(text.rlike("faq|question|પ્રશ્નોત્તર"), "FAQ").when(text.rlike("grievance|complaint|ફરિયાદ"), "GRIEVANCE_PAGE").when(text.rlike("guideline|instruction|manual|circular"), "GUIDELINE")
        .when((path == "") | (path == "/") | path.rlike(r"^/(index|home|default)\b"), "PORTAL_HOME")
        .when(only("OFFICE"), "OFFICE_DIRECTORY").when(only("HELPLINE"), "HELPLINE").when(only("TRACKING"), "TRACKING_PAGE").when(only("APP"), "MOBILE_APP_INFO").otherwise("SERVICE_PAGE")
    )
