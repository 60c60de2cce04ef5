"""Column functions and the small value functions they share with the scoring kernel."""
