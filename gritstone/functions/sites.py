"""What a page is worth and whose it is, by its address and words: scores, admissibility, other states, kinds of sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .claims import let, stripped
from .text import host

# Weighted signals of addresses and titles, for and against.
URL_FOR = (
    (6, r"eligib|who can apply|documents? required|required documents?|how to apply|checklist|પાત્રતા|જરૂરી ?દસ્તાવેજ"),
    (5, r"\bapply\b|application form|online application|new application|અરજી|નવી ?અરજી"),
    (4, r"\bfee(s)?\b|charges|payment detail|processing time|time ?limit|ફી|સમય ?મર્યાદા"),
    (4, r"certificate|licen[cs]e|permit|registration|renewal|પ્રમાણપત્ર|પરવાનો|નોંધણી"),
    (3, r"\bservice(s)?\b|\bseva\b|scheme|yojana|benefit|સેવા|યોજના|સહાય"),
    (3, r"procedure|process|guideline|instruction|user manual|how ?to|પ્રક્રિયા"),
    (2, r"\bform\b|download|પત્રક|ડાઉનલોડ"),
    (2, r"grievance|complaint|helpline|toll ?free|escalat|ફરિયાદ|હેલ્પલાઇન"),
    (2, r"track|status|check status|સ્થિતિ"),
    (2, r"office|contact|address|કચેરી|સરનામ"),
)
URL_AGAINST = (
    (8, r"\bnews\b|press ?release|media|gallery|photo|video|album|event|celebrat|સમાચાર"),
    (8, r"\btender\b|\beoi\b|quotation|auction|procurement|bid ?document"),
    (6, r"screen ?reader|accessibility|site ?map|sitemap|privacy ?policy|disclaimer|terms ?of ?use|copyright|hyperlink ?policy|website ?policy"),
    (6, r"\brti\b.{0,12}(annual|quarterly|report)|annual ?report|budget ?speech|minutes ?of"),
    (5, r"recruit|vacanc|advertis|result|merit ?list|call ?letter|answer ?key|syllabus|exam ?schedule"),
    (4, r"\blogin\b|sign ?in|user ?id|forgot ?password|dashboard|admin\b"),
    (3, r"archive|old ?website|previous|\b(19|20)\d\d ?-? ?\d{0,4}\b.{0,6}archive"),
)
# Weighted signals of a page of a document, each counted once, and limits.
PAGE_FOR = (
    (4, r"(?i)\b(documents?\s+required|required\s+documents?|list\s+of\s+documents?|enclosures?)\b"),
    (4, r"(?i)\b(eligibility|eligible|qualifying\s+criteria|who\s+can\s+apply)\b"),
    (4, r"(?i)\b(application\s+(procedure|process)|how\s+to\s+apply|procedure\s+for\s+applying|step\s*[-\s]?\d)\b"),
    (3, r"(?i)\b(fee|fees|charges|rate\s+of|amount\s+payable|rs\.?\s*\d)\b"),
    (3, r"(?i)\b(income\s+limit|age\s+limit|annual\s+income|below\s+poverty)\b"),
    (3, r"(?i)\b(scheme\s+guidelines?|resolution|circular|annexure|schedule\s+[ivx]+)\b"),
    (3, r"(?i)\b(verification|scrutiny|sanction|selection|approval|renewal)\b"),
    (2, r"(?i)\b(helpline|toll\s*free|grievance|contact\s+(us|number)|email)\b"),
    (2, r"(?i)\b(certificate|licence|license|permit|registration|subsidy|assistance|pension|scholarship)\b"),
    (1, r"(?i)\b(office|mamlatdar|collector|taluka|district|municipal|department)\b"),
    (4, r"જરૂરી\s*દસ્તાવેજ|આધાર\s*પુરાવા|સાધનિક\s*કાગળો"),
    (4, r"પાત્રતા|લાયકાત|યોગ્યતા"),
    (3, r"અરજી\s*કરવાની|અરજી\s*પ્રક્રિયા|પ્રક્રિયા"),
    (3, r"સહાય|યોજના|ઠરાવ|પરિપત્ર"),
    (2, r"ફી|રકમ|દર"),
)
PAGE_AGAINST = (
    (6, r"(?i)\b(tender|e-?tender|bid\s+document|quotation|corrigendum)\b"),
    (5, r"(?i)\b(minutes\s+of\s+the\s+meeting|agenda|committee\s+members?|board\s+of\s+directors)\b"),
    (5, r"(?i)\b(annual\s+report|audit\s+report|balance\s+sheet|budget\s+estimate)\b"),
    (4, r"(?i)\b(merit\s+list|result|seniority\s+list|roll\s+number|admit\s+card|answer\s+key)\b"),
    (4, r"(?i)\b(press\s+note|news\s*letter|photo\s+gallery|speech)\b"),
    (3, r"(?i)\b(recruitment|vacanc|advertisement\s+no|syllabus|exam\s+schedule)\b"),
)
LEAST_PAGE, KEEP_ABOVE = 220, 5
# Official hosts, other states as they stand in addresses and in texts, pages that state no rule in force.
OFFICIAL = r"(^|\.)(gov|nic)\.in$"
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra",
    "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttarakhand", "Uttar Pradesh", "West Bengal",
    "Jammu and Kashmir", "Ladakh", "Puducherry",
)
HOME = r"(?i)\bgujarat\b|ગુજરાત"
STATE_IN_URL = (
    "andhra|arunachal|assam|bihar|chhattisgarh|goa|haryana|himachal|jharkhand|karnataka|kerala|madhya[-_]?pradesh|maharashtra|manipur|meghalaya|mizoram|nagaland|odisha|punjab|rajasthan|sikkim|tamil[-_]?nadu|"
    "telangana|tripura|uttar[-_]?pradesh|uttarakhand|west[-_]?bengal|jammu|kashmir|ladakh|puducherry|chandigarh"
)
STATE_CODE = r"\.(ap|ar|as|br|cg|ga|hp|hr|jh|jk|ka|kl|la|ld|mh|ml|mn|mp|mz|nl|od|pb|py|rj|sk|tn|tr|ts|uk|up|wb|an|ch|dd|dn)\.gov\.in$"
STATE_DEPARTMENT = r"^(hry|pb|mh|ap|ts|ka|tn|up|mp|rj|wb|od|br|jh|cg|hp|uk)(labour|labor|police|rto|excise|revenue|health|fire|panchayat|urban|municipal|transport|forest|industries|pollution|treasury)"
OTHER_CITY = r"^(ghmc|bbmp|mcgm|pmc|kmc|nmmc|bmc|ndmc|mcd|dda)$"
NO_RULE_PAGE = r"(?i)/(blog|bloglist|blogs|news|press|media|gallery|tenders?|recruitment|vacanc)"
NOT_IN_FORCE = r"(?i)rfp|rfq|\bbid\b|eoi|landdisposal|draft[-_]?(notice|rules?|regulation)|_draft|comments?[-_]invited"
REGULATOR = r"^(www\.)?(fssai|peso|aerb|cdsco|cgwa|dgft)\."
RULE_MARKER = r"(?i)\b(shall|must|require[ds]?|needs?|obtain|apply|application|issued?|grant(ed)?|prescribed|exempt|liable|permitted|valid|renew|not apply)\b|\d"
FORM_ROW = r"(?i)^form\s*(no\.?|number)?\s*[-–]?\s*[ivxlc0-9]"
# What makes a fact a fee to pay, a time to wait, a rule of who qualifies, and what doesn't.
PAYS = r"(?i)\b(fee|fees|charge|charges|cost|costs|price|payable|pay)\b"
NO_FEE = (
    r"(?i)\b(crore|allocat\w*|budget|outlay|subsid\w*|grant\w*|assistance|incentive|reimburs\w*|scholarship|stipend|benefit|award\w*|prize|loan|income|salary|turnover|investment)\b",
    r"(?i)\b(receives?|receiving|offers?|disburs\w*|provided\s+(?:for|to)|payable\s+to\s+the\s+(?:mentor|agency|consultant|operator))\b",
    r"(?i)\b(?:projects?|unit|package|programme?|total|eligible|capital|installation|construction)\s+cost\b|\bcost\s+of\s+(?:the\s+)?(?:programmes?|projects?|one|raw|transport\w*|travel)\b",
)
TAKES = r"(?i)processing time|time (?:limit|frame|period)|is (?:issued|delivered|provided)|will be (?:issued|delivered|provided)|issued (?:in|within)|delivered (?:in|within)|disposed of|completed (?:in|within)|takes"
NO_WAIT = r"(?i)\b(appeal|revision|course duration|valid for|validity|renew\w*|before the|prior to|deadline for applying|last date)\b"
QUALIFIES = (
    r"(?i)must (?:be|have|not|hold|possess|own|reside|belong)|is eligible|are eligible|eligible (?:for|if|to|under|candidates?|applicants?|beneficiar\w+)|not eligible|ineligible|is excluded|are excluded|excluded from|"
    r"open (?:only )?to|is applicable to|are applicable to|is available (?:only )?(?:for|to)|are available (?:only )?(?:for|to)|requires? (?:the )?(?:candidate|applicant)|should (?:be|have)|can apply|may apply|can avail"
)
NO_CRITERION = r"(?i)aims? to|was (?:formed|established|launched|set up|started|created)|(?:have|has) been provided|is intended to promote"


def _weight(text: Column, rules: tuple[tuple[int, str], ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(text.rlike(p), w).otherwise(0) for w, p in rules))


def url_score(url: Column, title: Column, description: Column) -> Column:
    """How much an address looks like a page to read: signals of the path count double, those of title and description once; a home page +8, a PDF +1, a record -6."""
    raw = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^https?://[^/]+", "")
    path = F.lower(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))  # one that can't be decoded stays as it is
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    home = (path == "") | (path == "/") | path.rlike(r"^/(index|home|default)\.\w+$")
    extra = F.when(home, 8).otherwise(0) + F.when(path.rlike(r"\.pdf$"), 1).otherwise(0) - F.when(path.rlike(r"[?&](id|no|num|srno)=\d+"), 6).otherwise(0)
    return 2 * (_weight(path, URL_FOR) - _weight(path, URL_AGAINST)) + _weight(text, URL_FOR) - _weight(text, URL_AGAINST) + extra


def page_score(text: Column) -> Column:
    """How much a page of a document is about getting a service; 0 under 220 characters. One over KEEP_ABOVE is worth reading."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) < LEAST_PAGE, 0).otherwise(_weight(text, PAGE_FOR) - _weight(text, PAGE_AGAINST))


def official(url: Column) -> Column:
    return F.coalesce(host(url).rlike(OFFICIAL), F.lit(False))


def wrong_state(url: Column) -> Column:
    """Whether an address speaks of another state: by a name in it, a state's code in its host, or a department or city of another one as its first label."""
    low, own = F.lower(url), F.coalesce(host(F.lower(url)), F.lit(""))
    label = F.get(F.split(own, r"\."), F.lit(0))
    return ~F.contains(low, F.lit("gujarat")) & (low.rlike(STATE_IN_URL) | own.rlike(STATE_CODE) | (own.rlike(r"\.gov\.in$") & (label.rlike(STATE_DEPARTMENT) | label.rlike(OTHER_CITY))))


def states_a_rule(url: Column) -> Column:
    """Whether an address isn't that of news, offers, tenders or drafts."""
    return ~url.rlike(NO_RULE_PAGE) & ~url.rlike(NOT_IN_FORCE)


def source_rank(url: Column) -> Column:
    """0 for the home state's hosts, 1 for regulators', 2 for others of the government, 3 for the rest."""
    own = F.coalesce(host(url), F.lit(""))
    return F.when(F.contains(own, F.lit("gujarat")), 0).when(own.rlike(REGULATOR), 1).when(own.endswith(".gov.in"), 2).otherwise(3)


def is_sentence(text: Column) -> Column:
    """Whether a text is a rule in words: 40 characters and eight words or more, with a rule's verb or a number; no row of forms, and no menu (a pipe, or eight long words of which under 0.65 are distinct)."""

    def menu(t: Column) -> Column:
        return let(F.regexp_extract_all(F.lower(t), F.lit(r"([a-z]{4,})"), 1), lambda words: (F.size(words) >= 8) & (F.size(F.array_distinct(words)) < 0.65 * F.size(words)))

    told = let(stripped(text), lambda t: (F.length(t) >= 40) & ~F.contains(t, F.lit("|")) & ~t.rlike(FORM_ROW) & t.rlike(r"^(?:\S+\s+){7}\S") & t.rlike(RULE_MARKER) & ~menu(t))  # what is cheap first
    return F.coalesce(told, F.lit(False))


def other_state(text: Column) -> Column:
    """The one other state that a text names if it doesn't name the home state; null if it names none or several."""
    named = F.filter(F.array(*(F.when(text.rlike(rf"(?i)\b{s}\b"), s) for s in STATES)), lambda s: s.isNotNull())
    some = text.rlike(rf"(?i)\b(?:{'|'.join(STATES)})\b") & ~text.rlike(HOME)  # most texts name none: one search tells
    return F.when(some, let(named, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0)))))


def is_fee(kind: Column, detail: Column, claim: Column) -> Column:
    """Whether a fact tells what an applicant pays: an amount, a word for it, and none for money that goes the other way or for what a thing costs."""
    given = F.coalesce(F.try_element_at(detail, F.lit("amount")) != "", F.lit(False))
    return F.coalesce((kind == "FEE") & given & claim.rlike(PAYS) & reduce(lambda a, b: a & b, (~claim.rlike(p) for p in NO_FEE)), F.lit(False))


def is_wait(kind: Column, detail: Column, claim: Column) -> Column:
    """Whether a fact tells how long an office takes, and not another deadline."""
    given = F.coalesce(F.try_element_at(detail, F.lit("days")) != "", F.lit(False))
    return F.coalesce((kind == "TIMELINE") & given & claim.rlike(TAKES) & ~claim.rlike(NO_WAIT), F.lit(False))


def is_criterion(kind: Column, claim: Column) -> Column:
    """Whether a fact tells who qualifies, and not what a scheme is for."""
    return F.coalesce((kind == "ELIGIBILITY") & claim.rlike(QUALIFIES) & ~claim.rlike(NO_CRITERION), F.lit(False))
