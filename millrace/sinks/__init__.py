"""Tables that batches and streams write to."""
