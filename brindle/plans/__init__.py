"""Plan helpers: lineage cuts and deterministic uniforms."""
