"""auditflow: repository analytics and corpus operators, Spark first."""
