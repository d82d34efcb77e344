from quiver.functions.vector import (  # noqa: F401
    cosine_similarity,
    dot_product,
    l2_distance,
    metric_score,
    normalize_metric,
    ascending,
    vector_literal,
)
from quiver.functions.text import (  # noqa: F401
    epoch_ms_to_rfc3339,
    parse_cpu,
    parse_doc_count,
    parse_memory_mib,
    parse_percent,
)
