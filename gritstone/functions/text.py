"""Text and URL functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


#: White space as the web's languages know it.
_WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Fixed steps of the verbatim normaliser, in order: pattern and what takes its place.
UNMARK = (
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\\([-.*_\[\]()#+!`>~|])", "$1"),
    (r"[*_`~]", ""),
    (r"(?i)</?[a-z][^>]{0,200}>", " "),
    (r"[\x{2018}\x{2019}\x{201B}]", "'"),
    (r"[\x{201C}\x{201D}]", '"'),
    (r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", ""),
    (rf"(?m)^[ \t]*[-+\x{{2022}}]{_WS}+", ""),
    (rf"{_WS}+", " "),
)


#: White space again, but letters of ASCII are ruled out at once; a single plain space, which stays, is no match.
_GAP = r"[\x09-\x20\x{A0}-\x{FEFF}&&" + _WS + "]"
_GAPS = rf" {_GAP}+|[\x09-\x1F\x{{A0}}-\x{{FEFF}}&&{_WS}]{_GAP}*"


#: What any step but the last acts on holds one of these.
_MARKED = r"[\[\\*_`~<\x{200B}-\x{2060}\x{FEFF}]|(?m)^[ \t]*[-+]"


def norm(text: Column) -> Column:
    """Text for verbatim comparison: markdown and tags off, escapes undone, quotes straight, nothing of no width, no leading bullets, white space single, lower case."""
    bare = text
    for pattern, to in UNMARK[:-1]:
        bare = F.regexp_replace(bare, pattern, to)
    return F.lower(F.trim(F.regexp_replace(F.when(text.rlike(_MARKED), bare).otherwise(text), _GAPS, UNMARK[-1][1])))


def stem(token: Column) -> Column:
    """A word of over three letters without its final s."""
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, 1, F.length(token) - 1)).otherwise(token)


def slug(text: Column) -> Column:
    """An identifier: lower case, other characters one underscore, at most 60; null if nothing is left."""
    return F.nullif(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_"), "^_+|_+$", ""), F.lit(60)), F.lit(""))


#: Fixed: the named references that are decoded; others stay as they are.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def decoded(text: Column) -> Column:
    """Character references resolved, each once."""

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|\w+);", 1))
        code = F.when(name.rlike("^#x"), F.conv(F.substring(name, 3, 8), 16, 16)).when(name.rlike("^#[0-9]"), F.conv(F.substring(name, 2, 8), 10, 16))
        char = reduce(lambda w, e: w.when(name == e[0], F.lit(e[1])), ENTITIES.items(), F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")))
        return F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)), "")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and marks of two characters or more, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0)), lambda t: F.length(t) > 1)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def clean_url(url: Column) -> Column:
    """URL with scheme and host in lower case, without fragment, tracking parameters and slashes at the end of its path, which is / at least; what isn't a URL stays as it is."""
    part = lambda k: F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)([^?#]*)(?:\?([^#]*))?", k)
    query = F.array_join(F.filter(F.split(part(3), "&"), lambda x: ~x.rlike("^(utm_|fbclid|gclid)")), "&")
    path = F.coalesce(F.nullif(F.regexp_replace(part(2), "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(part(1) == "", url).otherwise(F.concat(F.lower(part(1)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def bare(html: Column) -> Column:
    """html without comments and what is in scripts, styles and the like."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)<(script|style|noscript|svg|iframe)[^>]*>.*?</\1>", " ")


def anchors(html: Column, url: Column) -> Column:
    """Links of a page in order, as an array of (pos, url, title): http and https only, resolved against the page's url, without fragment, the first of equals; title is the link's text, 200 characters at most, or null."""
    pattern = r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a>"""
    base, scheme, folder = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)", 1), F.regexp_extract(url, r"^([a-zA-Z]+:)", 1), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*/)", 1)

    def link(m: Column, i: Column) -> Column:
        href = F.trim(decoded(F.regexp_extract(m, pattern, 1)))
        own = F.regexp_replace(href, "#.*$", "")
        full = (
            F.when(own.rlike("^[a-zA-Z][a-zA-Z0-9+.\\-]*:"), own).when(own.startswith("//"), F.concat(scheme, own)).when(own.startswith("/"), F.concat(base, own))
            .when(own.startswith("?"), F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), own)).otherwise(F.concat(base, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), own))
        )
        full = F.regexp_replace(full, r"^(https?://[^/?]+)(\?.*)?$", "$1/$2")
        return F.struct(i.alias("pos"), F.when((own != "") & full.rlike("^(?i)https?://"), full).alias("url"), F.nullif(F.left(tidy(F.regexp_extract(m, pattern, 2)), F.lit(200)), F.lit("")).alias("title"))

    found = F.filter(F.transform(F.regexp_extract_all(bare(html), F.lit(pattern), F.lit(0)), link), lambda x: x["url"].isNotNull())
    return F.get(F.transform(F.array(found), lambda held: F.filter(held, lambda x, i: F.array_position(held["url"], x["url"]) == i + 1)), F.lit(0))


def tidy(html: Column) -> Column:
    """Text of a piece of html: tags off, references decoded, white space single."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, r"<[^>]*>", " ")), f"{_WS}+", " "))


#: Fixed words that tell a missing page from its title or heading, and from a short text.
GONE_TITLE = r"\b(404|error|not found|page unavailable|access denied|bad gateway|service unavailable|under maintenance|forbidden)\b"
GONE_TEXT = r"(?i)error|not found|denied|failed|unavailable"


def soft_404(html: Column, content_type: Column | None = None) -> Column:
    """Whether a page that came says that there is none: by its title or heading, or by error words in a text of under 400 characters; XML and JSON only by title."""
    head = F.lower(F.concat(element(bare(html), "title"), F.lit(" "), element(bare(html), "h1")))
    text = F.array_join(lines(html), "\n")
    other = F.lit(False) if content_type is None else F.coalesce(content_type.rlike("xml|json"), F.lit(False))
    return head.rlike(GONE_TITLE) | (~other & (F.length(text) < 400) & text.rlike(GONE_TEXT))


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def input_hash(text: Column) -> Column:
    """Equal for inputs that differ in case, spacing and punctuation only."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), 256), 1, 32)


def lines(html: Column) -> Column:
    """Lines of a page's text: block ends break lines, cells are set apart by bars; blank lines and repeats of the line before are dropped."""
    s = bare(html)
    for pattern, to in ((r"(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table|title)>|<br[^>]*>", "\n"), (r"(?i)</t[dh]>", " | "), (r"<[^>]*>", " ")):
        s = F.regexp_replace(s, pattern, to)
    s = F.regexp_replace(decoded(s), r"[ \t\r\f\x{A0}]+", " ")
    found = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    held = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    return F.get(F.transform(F.array(found), held), F.lit(0))


def element(html: Column, tag: str) -> Column:
    """Text of the first element of that tag, white space single; empty if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return tidy(inner)


def description(html: Column) -> Column:
    """Content of the description meta element, its attributes in either order; empty if there is none."""
    name, content = r"""name=["']description["']""", r"""content=["']([^"']*)["']"""
    found = lambda p: F.nullif(F.regexp_extract(bare(html), p, 1), F.lit(""))
    return tidy(F.coalesce(found(f"(?i)<meta[^>]+{name}[^>]+{content}"), found(f"(?i)<meta[^>]+{content}[^>]+{name}"), F.lit("")))
