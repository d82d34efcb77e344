"""DuckDB spellings of the vector scores used by oracle SQL."""


def d(a: str) -> str:
    return f"CAST({a} AS DOUBLE[])"


def l2(a: str, b: str) -> str:
    return f"list_distance({d(a)}, {d(b)})"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({d(a)}, {d(b)})"


def cosine(a: str, b: str) -> str:
    na, nb = dot(a, a), dot(b, b)
    return f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE {dot(a, b)} / (sqrt({na}) * sqrt({nb})) END)"


def score(metric: str, a: str, b: str) -> str:
    return {"l2": l2, "cosine": cosine, "dot": dot}[metric](a, b)


def order(metric: str, col: str = "raw") -> str:
    return f"{col} ASC" if metric == "l2" else f"{col} DESC"


# Text parsing in DuckDB, mirroring quiver.functions.text.
FLOAT_RE = "'^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)'"
MEM_FACTOR = ("CASE regexp_extract(mem_text, '([KMGTP]i)$', 1) WHEN 'Ki' THEN 1.0/1024 WHEN 'Gi' THEN 1024.0 "
              "WHEN 'Ti' THEN 1048576.0 WHEN 'Pi' THEN 1073741824.0 ELSE 1.0 END")


def leading_float(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, {FLOAT_RE}, 1) AS DOUBLE)"


def strip_suffix(col: str, suffix: str) -> str:
    return f"regexp_replace({col}, '{suffix}$', '')"


def cpu_cores(col: str = "cpu_text") -> str:
    return f"coalesce({leading_float(strip_suffix(col, 'm'))}, 0) / 1000.0"


def memory_mib(col: str = "mem_text") -> str:
    return f"coalesce({leading_float(col)} * {MEM_FACTOR.replace('mem_text', col)}, 0)"


def percent(col: str = "disk_text") -> str:
    return f"coalesce({leading_float(strip_suffix(col, '%'))}, 0)"
