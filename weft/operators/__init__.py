"""Machine algebra and inference."""
