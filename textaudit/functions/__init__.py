"""Column-expression helpers (JVM-side, inside whole-stage codegen) and small scalar math."""
