"""Find DNS resolvers that manipulate answers, from passive response logs, on Spark."""

from resolver_audit.settings import AuditSettings

__all__ = ["AuditSettings"]
