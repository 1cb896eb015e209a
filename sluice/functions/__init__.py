"""Column-expression builders (JVM-side, codegen friendly)."""
from sluice.functions.jsonpath import *  # noqa: F401,F403
from sluice.functions.casts import *  # noqa: F401,F403
from sluice.functions.timefmt import *  # noqa: F401,F403
