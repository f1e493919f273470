"""Column builders: expressions that stay inside whole-stage codegen."""
