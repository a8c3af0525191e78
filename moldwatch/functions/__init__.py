"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""
from moldwatch.functions.columns import *  # noqa: F401,F403
