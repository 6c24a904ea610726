"""Names of bodies, offices and places: page furniture taken off, types by word patterns, labels of scopes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .claims import is_person, let, stripped

# What stands around a name on a page, words of bodies, labels that are no names, types of offices in order.
NAME_NOISE = r"(?i)^(home|welcome( to)?|index|official website( of)?)\s*[|:\-–—]*\s*|\s*[|:\-–—]+\s*(home|official website|government of gujarat|gujarat government|goverment of gujarat)\s*$"
BODY_WORD = (
    r"(?i)department|directorate|mission|board|corporation|commission|committee|authority|council|office|centre|center|bureau|nigam|mandal|yojana|portal|universit|court|panchayat|municipal|police|"
    r"વિભાગ|નિગમ|યોજના|કચેરી|પંચાયત"
)
NO_NAME = r"(?i)^(banner|logo|slider|header|footer|menu|navigation|main( content)?|content|image|photo|title|untitled|welcome|home ?page|skip to (main )?content|search|login|sign in|left|right|top|bottom)$"
FIELD_LABEL = (
    r"(?i)^(office\s*)?(address|addresses|contact|contacts|contact\s*(no|number|numbers|details|information|info|us)|phone|phone\s*no|telephone|mobile|email|e-mail|location|locations|hours|timing|timings|fax|website|url|"
    r"name|designation|head\s*office|main\s*office|regional\s*office|branch\s*office|temporary\s*campus|conducted\s*at|competent\s*person|helpline|details|information|more|other|general|home|office)$"
)
OFFICE_TYPES = (
    (r"passport\s*seva|psk\b|post\s*office\s*passport", "Passport Seva Kendra"),
    (r"aadhaar\s*(seva|enrol|enroll)|uidai", "Aadhaar Seva Kendra"),
    (r"regional\s*transport|\brto\b|\barto\b|transport\s*office", "Regional Transport Office"),
    (r"jan\s*seva\s*kendra|citizen\s*service\s*cent(re|er)|\bcsc\b|e-?gram", "Jan Seva Kendra"),
    (r"sub[- ]?registrar|registrar\s*of\s*(assurance|document)", "Sub Registrar Office"),
    (r"mamlatdar|mamaltdar", "Mamlatdar Office"),
    (r"taluka\s*(panchayat|development|office)|\btdo\b", "Taluka Panchayat"),
    (r"district\s*panchayat|\bddo\b|district\s*development", "District Panchayat"),
    (r"collector|district\s*magistrate|prant|deputy\s*collector", "District Collectorate"),
    (r"municipal\s*corporation|mahanagar\s*palika|\b(amc|smc|vmc|rmc|bmc|jmc)\b", "Municipal Corporation"),
    (r"nagarpalika|nagar\s*palika|municipality|municipal\s*council", "Municipality"),
    (r"gram\s*panchayat|village\s*panchayat|panchayat\s*office", "Gram Panchayat"),
    (r"employees'?\s*provident|\bepfo\b|provident\s*fund", "EPFO Office"),
    (r"employees'?\s*state\s*insurance|\besic\b", "ESIC Office"),
    (r"police\s*station|police\s*commissioner|superintendent\s*of\s*police", "Police Office"),
    (r"civil\s*hospital|primary\s*health|community\s*health|health\s*cent(re|er)|\bphc\b|\bchc\b", "Health Facility"),
    (r"land\s*record|superintendent\s*of\s*land|\bslr\b|city\s*survey", "Land Records Office"),
    (r"social\s*(welfare|defence|justice)|scheduled\s*caste|tribal\s*development", "Social Welfare Office"),
    (r"district\s*education|education\s*office|\bdeo\b|\bdpeo\b", "District Education Office"),
    (r"district\s*supply|supply\s*office|food\s*and\s*civil\s*supplies|rationing", "Civil Supplies Office"),
    (r"labour\s*(office|commissioner)|industrial\s*safety", "Labour Office"),
    (r"treasury|pay\s*and\s*accounts", "Treasury Office"),
    (r"court|tribunal|nyayalaya", "Court"),
    (r"bank\b|branch\b", "Bank Branch"),
)
NAME_KEYS = ("officeName", "office_name", "name", "institute_name", "institute")
#: Fixed: districts, and what hosts call some of them.
ROOT = "IN-GJ"
DISTRICTS = (
    "AHMEDABAD", "AMRELI", "ANAND", "ARAVALLI", "BANASKANTHA", "BHARUCH", "BHAVNAGAR", "BOTAD", "CHHOTA_UDEPUR",
    "DAHOD", "DANG", "DEVBHOOMI_DWARKA", "GANDHINAGAR", "GIR_SOMNATH", "JAMNAGAR", "JUNAGADH", "KHEDA", "KUTCH",
    "MAHISAGAR", "MEHSANA", "MORBI", "NARMADA", "NAVSARI", "PANCHMAHAL", "PATAN", "PORBANDAR", "RAJKOT",
    "SABARKANTHA", "SURAT", "SURENDRANAGAR", "TAPI", "VADODARA", "VALSAD",
)
DISTRICT_ALIASES = {
    "dwarka": "DEVBHOOMI_DWARKA", "kachchh": "KUTCH", "bhuj": "KUTCH", "somnath": "GIR_SOMNATH", "veraval": "GIR_SOMNATH", "panchmahals": "PANCHMAHAL", "godhra": "PANCHMAHAL",
    "chhotaudepur": "CHHOTA_UDEPUR", "modasa": "ARAVALLI", "lunawada": "MAHISAGAR", "ahwa": "DANG",
}


def district_patterns() -> list[tuple[str, str]]:
    """(pattern, scope) of every district and alias, in order."""
    return [(d.lower().replace("_", ""), f"{ROOT}-{d}") for d in DISTRICTS] + [(a, f"{ROOT}-{d}") for a, d in DISTRICT_ALIASES.items()]


def office_type(name: Column) -> Column:
    """The type of the first pattern that a name has; null without any."""
    return F.coalesce(*(F.when(name.rlike(f"(?i){p}"), t) for p, t in OFFICE_TYPES))


def read_name(heading: Column, title: Column) -> Column:
    """What a body calls itself: its page's heading or title without furniture, whichever scores more; the heading on a tie, null if neither is a name.

    A word of public bodies counts 2, a number of two digits or more -3. A name has 4 to 120 characters and a letter.
    """
    bare = lambda c: stripped(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), NAME_NOISE, ""), r"\s+", " "))
    good = lambda n: F.length(n).between(4, 120) & n.rlike(r"\p{L}") & ~n.rlike(NO_NAME)
    score = lambda n: F.when(n.rlike(BODY_WORD), 2).otherwise(0) - F.when(n.rlike(r"\d{2,}"), 3).otherwise(0)
    told = F.filter(F.array(bare(heading), bare(title)), good)
    ranked = F.transform(told, lambda n, i: F.struct((-score(n)).alias("s"), i.alias("i"), n.alias("n")))
    return F.array_min(ranked)["n"]


def name_of(detail: Column, object_: Column, title: Column) -> Column:
    """struct(name, status) of a fact's office: a printed name, else an object that names a type of office (EXTRACTED), else the type in the page's title (NORMALIZED); null otherwise."""

    def printed(key: str) -> Column:
        return let(stripped(F.regexp_replace(F.coalesce(F.try_element_at(detail, F.lit(key)), F.lit("")), r"\s+", " ")), lambda v: F.when(F.length(v).between(4, 119) & ~v.rlike(FIELD_LABEL) & ~is_person(v), v))

    spaced = F.replace(F.coalesce(object_, F.lit("")), F.lit("_"), F.lit(" "))
    thing = stripped(F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2))))
    named = F.coalesce(*(printed(k) for k in NAME_KEYS), let(thing, lambda v: F.when((F.length(v) > 4) & ~v.rlike(FIELD_LABEL) & office_type(v).isNotNull(), v)))
    page = let(stripped(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")), lambda t: F.when(F.length(t).between(5, 199), office_type(t)))
    told = lambda n, status: F.struct(n.alias("name"), F.lit(status).alias("status"))
    return let(F.struct(named.alias("n"), page.alias("p")), lambda x: F.when(x["n"].isNotNull(), told(x["n"], "EXTRACTED")).when(x["p"].isNotNull(), told(x["p"], "NORMALIZED")))


def scope_label(scope: Column) -> Column:
    """A scope as a reader would say it."""
    district = F.regexp_extract(scope, f"^{ROOT}-(.+)$", 1)
    words = F.initcap(F.lower(F.replace(district, F.lit("_"), F.lit(" "))))
    return F.when(scope.isNull() | scope.isin("", "IN"), "India").when(scope == ROOT, "Gujarat").when(district == "", scope).otherwise(F.concat(words, F.lit(" district, Gujarat")))


def index_text(scope: Column, heading: Column, text: Column) -> Column:
    """What a passage is found by: its district, heading and text, a line each; the text that is quoted stays as it is."""
    said = F.replace(F.replace(scope, F.lit(f"{ROOT}-"), F.lit("")), F.lit("_"), F.lit(" "))
    parts = F.filter(F.array(said, heading, text), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(parts, "\n")
