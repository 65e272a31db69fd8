"""Joins, clustering, trees and sorts over point sets, and graph components."""
