"""Named jobs over the given tables, each paired with an independent SQL oracle.

Importing this package registers every job; ``quiver.plans.registry`` holds them.
"""

from quiver.plans import registry  # noqa: F401
from quiver.plans import (  # noqa: F401
    vector_plans,
    index_plans,
    tenant_plans,
    metric_plans,
    health_plans,
    log_plans,
    export_plans,
    source_plans,
    stream_plans,
)
