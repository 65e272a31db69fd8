"""Point sets from generators and files, and sinks for them."""
