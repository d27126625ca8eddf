"""Names that a scan reads, by how they end, and what in a path makes it be left out."""

EXTENSIONS = (".vue", ".js", ".ts", ".css")
IGNORED = r"\.git|node_modules|\.idea|build|dist|\.env"
