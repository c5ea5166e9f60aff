"""State machines over packet and frame streams."""
