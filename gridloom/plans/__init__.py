"""Physical helpers and the command-line front end."""
