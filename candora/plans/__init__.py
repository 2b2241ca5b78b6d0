"""Physical building blocks: materialisation, global order, skew-proof joins."""
