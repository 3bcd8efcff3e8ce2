"""Reports as JSON, SARIF and Markdown, and ledgers."""
