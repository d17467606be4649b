"""The priority model as Column expressions; the only place its numbers live."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model: weights, priors, cut-points, class map and wording.
WEIGHT_CVSS = Decimal("0.25")
WEIGHT_EPSS = Decimal("0.30")
WEIGHT_KEV = Decimal("0.20")
WEIGHT_RANSOMWARE = Decimal("0.10")
WEIGHT_SSVC_EXPLOITATION = Decimal("0.06")
WEIGHT_SSVC_AUTOMATABLE = Decimal("0.02")
WEIGHT_SSVC_IMPACT = Decimal("0.02")
WEIGHT_CWE = Decimal("0.05")

CVSS_PRIOR = Decimal("5.0")
CWE_NEUTRAL = Decimal("0.5")
MOVEMENT_THRESHOLD = Decimal("0.05")

BAND_CUTS = (("critical", 65), ("high", 45), ("moderate", 25))
LOWEST_BAND = "low"

# Severity of each weakness class, and the class of each rated weakness.
CLASS_SEVERITY = {
    "Memory corruption": Decimal("1.0"),
    "Injection / code execution": Decimal("1.0"),
    "Access control / traversal": Decimal("0.8"),
    "Authentication bypass": Decimal("0.8"),
    "Request forgery / XSS": Decimal("0.6"),
    "Information disclosure": Decimal("0.4"),
    "DoS / resource exhaustion": Decimal("0.3"),
}
CLASS_OF = {
    "CWE-22": "Access control / traversal",
    "CWE-59": "Access control / traversal",
    "CWE-74": "Injection / code execution",
    "CWE-77": "Injection / code execution",
    "CWE-78": "Injection / code execution",
    "CWE-79": "Request forgery / XSS",
    "CWE-89": "Injection / code execution",
    "CWE-94": "Injection / code execution",
    "CWE-119": "Memory corruption",
    "CWE-120": "Memory corruption",
    "CWE-121": "Memory corruption",
    "CWE-122": "Memory corruption",
    "CWE-125": "Memory corruption",
    "CWE-190": "Memory corruption",
    "CWE-200": "Information disclosure",
    "CWE-203": "Information disclosure",
    "CWE-269": "Access control / traversal",
    "CWE-284": "Access control / traversal",
    "CWE-287": "Authentication bypass",
    "CWE-288": "Authentication bypass",
    "CWE-306": "Authentication bypass",
    "CWE-352": "Request forgery / XSS",
    "CWE-400": "DoS / resource exhaustion",
    "CWE-416": "Memory corruption",
    "CWE-434": "Injection / code execution",
    "CWE-476": "DoS / resource exhaustion",
    "CWE-502": "Injection / code execution",
    "CWE-787": "Memory corruption",
    "CWE-862": "Access control / traversal",
    "CWE-863": "Access control / traversal",
    "CWE-918": "Request forgery / XSS",
}
UNRATED_CLASS = "Weakness"

CVE_ID_PATTERN = r"^CVE-[0-9]{4}-[0-9]{4,}\z"

SEVERITY_OF = {member: CLASS_SEVERITY[label] for member, label in CLASS_OF.items()}

COMPONENTS = ("c_cvss", "c_epss", "c_kev", "c_ransomware", "c_ssvc", "c_cwe")

_WEIGHTS = (
    WEIGHT_CVSS, WEIGHT_EPSS, WEIGHT_KEV, WEIGHT_RANSOMWARE,
    WEIGHT_SSVC_EXPLOITATION, WEIGHT_SSVC_AUTOMATABLE, WEIGHT_SSVC_IMPACT, WEIGHT_CWE,
)
if sum(_WEIGHTS) != Decimal("1.00"):
    raise ValueError("the model weights must add up to exactly 1.00")

PART = "decimal(6,4)"


def _part(value: Column) -> Column:
    return F.round(value, 4).cast(PART)


def _earned(condition: Column, weight: Decimal) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(Decimal("0.00"))).cast(PART)


# -- weakness classes --------------------------------------------------------------------

def merged_weaknesses(*arrays: Column) -> Column:
    """All members of several weakness arrays; a missing array counts as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(a, empty) for a in arrays])


# Rated ids, most severe first and by id within a tier.
RANKED_MEMBERS = sorted(SEVERITY_OF, key=lambda member: (-SEVERITY_OF[member], member))


def top_weakness(members: Column) -> Column:
    """Highest-severity rated member, smallest id on a tie, NULL when none is rated.

    An intersection lists its matches in the order of its first array, so intersecting the
    ranked ids with a row's members puts the winner first: no explode, join or sort.
    """
    ranked = F.array(*[F.lit(member) for member in RANKED_MEMBERS])
    return F.get(F.array_intersect(ranked, members), F.lit(0))


def _by_weakness(cwe: Column, values: dict) -> Column:
    """One CASE arm per distinct value."""
    arms = None
    for value in dict.fromkeys(values.values()):
        ids = [m for m, v in values.items() if v == value]
        test = cwe.isin(ids)
        arms = F.when(test, F.lit(value)) if arms is None else arms.when(test, F.lit(value))
    return arms


def weakness_severity(cwe: Column) -> Column:
    return _by_weakness(cwe, SEVERITY_OF)


def weakness_class(cwe: Column) -> Column:
    """Class label of a weakness id; unrated ids get the generic label."""
    return F.coalesce(_by_weakness(cwe, CLASS_OF), F.lit(UNRATED_CLASS))


# -- components, score, band -------------------------------------------------------------

def cvss_score(v31: Column, v2: Column) -> Column:
    return F.coalesce(v31, v2)


def cvss_imputed(v31: Column, v2: Column) -> Column:
    return v31.isNull() & v2.isNull()


def risk_components(
    *,
    v31: Column,
    v2: Column,
    probability: Column,
    listed: Column,
    ransomware: Column,
    exploitation: Column,
    automatable: Column,
    impact: Column,
    top_cwe: Column,
) -> dict[str, Column]:
    """The six weighted parts, each an exact decimal of four places."""
    return {
        "c_cvss": _part(F.lit(WEIGHT_CVSS) * F.coalesce(v31, v2, F.lit(CVSS_PRIOR)) / F.lit(Decimal("10"))),
        "c_epss": _part(F.lit(WEIGHT_EPSS) * F.coalesce(probability, F.lit(Decimal("0")))),
        "c_kev": _earned(listed, WEIGHT_KEV),
        "c_ransomware": _earned(ransomware == "Known", WEIGHT_RANSOMWARE),
        "c_ssvc": (
            _earned(exploitation == "active", WEIGHT_SSVC_EXPLOITATION)
            + _earned(automatable == "yes", WEIGHT_SSVC_AUTOMATABLE)
            + _earned(impact == "total", WEIGHT_SSVC_IMPACT)
        ).cast(PART),
        "c_cwe": _part(F.lit(WEIGHT_CWE) * F.coalesce(weakness_severity(top_cwe), F.lit(CWE_NEUTRAL))),
    }


def risk_total(parts: dict[str, Column] | None = None) -> Column:
    """0-100 score with one decimal from the six parts (columns by default)."""
    columns = [parts[name] if parts else F.col(name) for name in COMPONENTS]
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return F.round(total * F.lit(Decimal("100")), 1).cast("decimal(5,1)")


def risk_band(score: Column) -> Column:
    """Band of the exact score; the cut-points are inclusive."""
    (first, cut), *rest = BAND_CUTS
    band = F.when(score >= cut, first)
    for label, cut in rest:
        band = band.when(score >= cut, label)
    return band.otherwise(LOWEST_BAND)


def whole_points(part: Column) -> Column:
    """A 0-1 part as whole points out of 100, half away from zero."""
    return F.round(F.coalesce(part, F.lit(Decimal("0"))) * F.lit(Decimal("100")), 0).cast("int")


def score_points(score: Column) -> Column:
    return F.round(score, 0).cast("int")


def likelihood_band(probability: Column, percentile: Column) -> Column:
    """Reading of a likelihood score; a missing one is unscored, not low."""
    return (
        F.when(probability.isNull(), "unscored")
        .when(probability >= Decimal("0.5"), "high")
        .when(probability >= Decimal("0.1"), "elevated")
        .when(percentile >= Decimal("0.95"), "top 5%")
        .when(probability < Decimal("0.01"), "low")
        .otherwise("middle")
    )


# -- prose -------------------------------------------------------------------------------

def likelihood_movement(probability: Column, previous: Column, previous_date: Column) -> Column:
    """Wording for a move of at least the threshold since the last publication, else ''."""
    verb = F.when(probability > previous, "rose").otherwise("fell")
    since = F.when(previous_date.isNotNull(), F.concat(F.lit(" since "), previous_date.cast("string")))
    text = F.concat(
        F.lit(" — EPSS "),
        verb,
        F.lit(" "),
        _five_places(previous),
        F.lit(" → "),
        _five_places(probability),
        F.coalesce(since, F.lit("")),
    )
    moved = F.abs(probability - previous) >= MOVEMENT_THRESHOLD
    return F.when(moved, text).otherwise("")


def _five_places(value: Column) -> Column:
    return value.cast("decimal(6,5)").cast("string")


# The wording of the clauses.
LISTED = "Listed in KEV"
LISTED_SINCE = " since "
LISTED_RANSOMWARE = " with known ransomware campaign use"
UNSCORED = "No EPSS score — this signal contributed nothing, it is not a low likelihood"
UNASSESSED = f"CVSS unassessed — scored at the neutral {CVSS_PRIOR} prior"
UNAVAILABLE = "CVSS unavailable"
UNRATED = "No rated weakness class — scored at the neutral default"
URGENCY = {
    "ssvc_exploitation": "exploitation=",
    "ssvc_automatable": "automatable=",
    "ssvc_technical_impact": "technical impact=",
}


def _said(*parts: Column | str, unless_empty: Column | None = None) -> Column:
    """Texts and columns in a row; NULL where a column is NULL, or the one named is empty."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return text if unless_empty is None else F.when(unless_empty != "", text)


def clause_texts() -> dict[str, Column]:
    """What a risk row's prose says of each signal; NULL where it says nothing."""
    of = F.col
    hundredths = F.bround(of("epss_percentile").cast("double") * F.lit(100.0)).cast("int")
    # Parts in brackets, those that are there, with commas between.
    brackets = F.concat_ws(", ", _said(hundredths, "th percentile"), _said("as of ", of("epss_scored_at")))
    moved = likelihood_movement(
        of("epss_probability"), of("epss_previous_probability"), of("epss_previous_scored_at")
    )
    bracketed = _said(" (", brackets, ")", unless_empty=brackets)
    urgency = F.concat_ws(", ", *[_said(label, of(name), unless_empty=of(name)) for name, label in URGENCY.items()])
    ransomware = F.when(of("known_ransomware_campaign_use") == "Known", LISTED_RANSOMWARE)
    listing = F.concat_ws("", F.lit(LISTED), _said(LISTED_SINCE, of("kev_date_added")), ransomware)
    scored = F.concat_ws("", F.lit("EPSS "), _five_places(of("epss_probability")), bracketed, moved)
    return {
        "listing": F.when(of("kev_listed"), listing),
        "likelihood": F.when(of("epss_probability").isNull(), UNSCORED).otherwise(scored),
        "severity": F.when(of("cvss_imputed"), UNASSESSED)
        .when(of("cvss_score").isNull(), UNAVAILABLE)
        .otherwise(_said("CVSS ", of("cvss_score"))),
        "urgency": _said("SSVC ", urgency, unless_empty=urgency),
        "weakness": F.when(of("cwe_top").isNull(), UNRATED).otherwise(
            _said(weakness_class(of("cwe_top")), " class, ", of("cwe_top"))
        ),
    }


def risk_rationale() -> Column:
    """Prose for a risk row: the band, then a sentence per signal, the largest share first.

    A signal that adds nothing is left out, but for the severity and for a missing likelihood,
    which a reader must know of.  Signals with equal shares keep the order of SIGNALS.
    """
    zero = F.lit(Decimal("0")).cast(PART)
    texts = clause_texts()
    always = {"severity": F.lit(True), "likelihood": F.col("epss_probability").isNull()}
    sentences = []
    for place, (signal, columns) in enumerate(SIGNALS.items()):
        share = sum((F.coalesce(F.col(c).cast(PART), zero) for c in columns), start=zero).cast("decimal(9,4)")
        told = (share > 0) | always.get(signal, F.lit(False))
        sentence = F.when(told, _said(texts[signal], " (+", whole_points(share), ")."))
        sentences.append(F.struct((-share).alias("less"), F.lit(place).alias("place"), sentence.alias("text")))
    score = F.coalesce(F.col("risk_score"), F.lit(Decimal("0")))
    opening = _said(F.initcap(risk_band(score)), " (", score_points(score), ").")
    # Untold sentences are NULL, which joining the texts passes over.
    return F.concat_ws(" ", opening, F.sort_array(F.array(*sentences))["text"])


# The weighted parts that each signal's sentence stands for.
SIGNALS = {
    "listing": ("c_kev", "c_ransomware"),
    "likelihood": ("c_epss",),
    "severity": ("c_cvss",),
    "urgency": ("c_ssvc",),
    "weakness": ("c_cwe",),
}
