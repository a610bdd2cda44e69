"""Load plans and the run skeleton around them."""
