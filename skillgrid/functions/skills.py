"""Skill names: canonical spelling, synonyms, categories, set scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skillgrid.functions.binding import bind
from skillgrid.functions.text import clean_items, strip, title_case

# Display spelling of lower-cased names that plain title case would get wrong.
CANONICAL_NAMES = {
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "sql": "SQL",
    "aws": "AWS",
    "gcp": "GCP",
    "node.js": "Node.js",
    "next.js": "Next.js",
    "ci/cd": "CI/CD",
    "tensorflow": "TensorFlow",
    "pytorch": "PyTorch",
    "scikit-learn": "Scikit-Learn",
    "postgresql": "PostgreSQL",
    "mysql": "MySQL",
    "mongodb": "MongoDB",
    "redis": "Redis",
    "kubernetes": "Kubernetes",
    "react": "React",
    "fastapi": "FastAPI",
}

# Short forms and the names they stand for.
SYNONYMS = {
    "ml": "Machine Learning",
    "ai": "Machine Learning",
    "genai": "Machine Learning",
    "react.js": "React",
    "reactjs": "React",
    "js": "JavaScript",
    "ts": "TypeScript",
    "node": "Node.js",
    "tf": "TensorFlow",
    "sklearn": "Scikit-Learn",
    "k8s": "Kubernetes",
    "postgres": "PostgreSQL",
    "py": "Python",
}

# Category labels and their substrings; the first label with a hit wins.
CATEGORY_RULES = [
    ("Programming Language", ["python", "java", "javascript", "c++", "c#", "go", "rust", "ruby", "php"]),
    ("Cloud Platform", ["aws", "azure", "gcp", "google cloud", "cloud"]),
    ("Database Technology", ["sql", "mongodb", "postgresql", "mysql", "redis", "cassandra"]),
    ("AI/Machine Learning", ["machine learning", "deep learning", "tensorflow", "pytorch", "ai"]),
    ("DevOps/Infrastructure", ["docker", "kubernetes", "jenkins", "terraform", "ansible"]),
    ("Web Framework", ["react", "angular", "vue", "django", "flask", "node"]),
    ("Data Engineering", ["spark", "kafka", "airflow", "hadoop", "hive"]),
]
OTHER_CATEGORY = "Other"

# Demand shown while no market data exists, in this order.
BASELINE_DEMAND = [
    ("Python", 250),
    ("SQL", 200),
    ("AWS", 180),
    ("Docker", 150),
    ("Kubernetes", 120),
    ("Java", 110),
    ("React", 100),
    ("Git", 90),
    ("Machine Learning", 85),
    ("TensorFlow", 70),
    ("Spark", 65),
    ("Kafka", 60),
]


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed mapping, null where the key is absent."""
    table = F.create_map(*[F.lit(part) for pair in values.items() for part in pair])
    return F.try_element_at(table, key)


def canonical_name(c: Column) -> Column:
    cleaned = strip(c)
    return F.coalesce(lookup(CANONICAL_NAMES, F.lower(cleaned)), title_case(cleaned))


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of each name, in order of first appearance."""
    return bind(items, lambda names: bind(F.transform(names, F.lower), lambda lowered: F.filter(
        names, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)))


def resolve_name(c: Column) -> Column:
    cleaned = strip(c)
    return F.coalesce(lookup(SYNONYMS, F.lower(cleaned)), canonical_name(cleaned))


def normalize_skills(items: Column) -> Column:
    """Synonym, else canonical name, else title case; blanks dropped; distinct ignoring case."""
    return distinct_ignoring_case(F.transform(clean_items(items), resolve_name))


def categorize(skill: Column) -> Column:
    def labelled(lowered: Column) -> Column:
        chain = F
        for label, parts in CATEGORY_RULES:
            hit = F.lit(False)
            # What holds a longer part holds the shorter one in it, so the shorter one decides.
            for part in (p for p in parts if not any(q != p and q in p for q in parts)):
                hit = hit | F.contains(lowered, F.lit(part))
            chain = chain.when(hit, F.lit(label))
        return chain.otherwise(F.lit(""))

    # Lower-cased once, not once for every part.
    return bind(F.lower(skill), labelled)


def jaccard(a: Column, b: Column) -> Column:
    """Of two skill lists, ignoring case; two empty lists are alike, one empty list is like nothing."""
    left, right = (F.array_distinct(F.transform(x, F.lower)) for x in (a, b))
    together = F.size(F.array_union(left, right))
    return F.when(together == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / together)


def truncated_percent(part: Column, total: Column) -> Column:
    """Percentage cut, not rounded, in double arithmetic: 29 of 100 gives 28."""
    share = part.cast("double") / total.cast("double")
    return F.when(total > 0, (share * F.lit(100.0)).cast("int")).otherwise(F.lit(0))


def fit_score(matched: Column, wanted: Column) -> Column:
    """Covered share in percent, rounded half to even, plus up to 15 points for the absolute overlap."""
    coverage = F.bround(matched / F.greatest(F.lit(1), wanted) * 100).cast("int")
    return F.least(F.lit(100), coverage + F.least(F.lit(15), matched * 3))


def score_points(score: Column) -> Column:
    """Similarity as whole points, at least one."""
    return F.greatest(F.lit(1), F.bround(score * 100).cast("int"))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))
