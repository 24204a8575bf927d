"""Model checkpoints as tables: inspecting, planning, transforming and verifying tensors with Spark."""
